import re

from panelforge.llm import licenses as L


def names(text):
    return [x[0] for x in L.scan(text)]


def test_each_template_is_found_as_itself():
    for name, text in L.TEMPLATES.items():
        text = re.sub("<year>", "2019-2021", re.sub("<holder>", "The Example Authors", text))
        assert names(f"Other words.\n{text}\nMore words here.") [0] == name, name


def test_small_changes_are_confirmed_and_others_not():
    mit = L.TEMPLATES["mit"].replace("person", "individual").replace("restriction", "limits")
    assert L.scan(mit)[0][:2] == ("mit", 3)
    assert names("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0-name"]
    assert names("Licensed under CC BY-NC 3.0.") == []
    assert names("He lost his license to drive and all rights to the car.") == []
    assert names("This work is not licensed under the GNU General Public License, version 2.") == []


def test_special_cases(spark):
    rows = [(1, None), (2, ""), (3, "x " * 50_000 + "\nAll rights reserved."), (3, "All rights reserved.\nAll rights reserved."), (None, "Released under the MIT License.")]
    got = L.scan_documents(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, found int")).collect()
    assert sorted((str(r.doc_id), [x.license for x in r.found]) for r in got) == [("1", []), ("2", []), ("3", ["all-rights-reserved"]), ("3", ["all-rights-reserved"] * 2), ("None", ["mit-name"])]
    assert L.scan_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_wrapped_headers_and_names_in_mid_sentence():
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"
    assert names(mpl) == ["mpl-2.0"]
    assert names("Licensed under the MIT License") == ["mit-name"]
    assert names("As said above, the code is available under the Apache License 2.0 for all.") == ["apache-2.0-title"]
    assert names("// SPDX-License-Identifier: MIT") == ["mit"]
    assert names("It comes under the GNU Lesser General Public License, version 2.1, as a whole.") == ["lgpl-2.1-title"]
    assert names("You have the GNU Affero General Public License version 3 here.") == ["agpl-3.0-title"]
    assert names("We chose the Eclipse Public License 2.0 for it.") == ["epl-2.0-title"]
    assert names("He has not read the Apache License 2.0 yet.") == []
