"""License scans by conditional compression.

The lines around a cue (licence, copyright, rights, ...), from BEFORE lines above it, hold the candidates: every word there that begins a template, or comes before a template's second word. For each template the block is as many words as the template has, from the candidate on over line ends. It is compressed twice by zstandard, alone and with the template as raw dictionary; the saving ranks the templates. The best ones are confirmed by their exact wording: words that must be put in, taken out or changed to make the template of the block, but for places the template leaves open. Of candidates that overlap the longest wording stays; one that `not` comes shortly before is none. SPDX lines are read by their identifier. Wordings that recur cost a look-up.

Results in special cases: null and empty texts have no license; equal savings go to the better wording, then to the first template; rows that repeat a doc_id each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table

# Wordings of public licenses and of the usual lines that name them. <...> stands for up to SLOT words.
TEMPLATES = {
    "mit-name": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0-name": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-title": "GNU General Public License, version 2",
    "gpl-3.0-title": "GNU General Public License, version 3",
    "lgpl-2.1-title": "GNU Lesser General Public License, version 2.1",
    "lgpl-3.0-title": "GNU Lesser General Public License, version 3",
    "agpl-3.0-title": "GNU Affero General Public License, version 3",
    "epl-2.0-title": "Eclipse Public License, version 2.0",
    "mpl-2.0-title": "Mozilla Public License, version 2.0",
    "apache-2.0-title": "Apache License, Version 2.0",
    "mit-title": "the MIT License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-4.0-name": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-name": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-name": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "all-rights-reserved": "All rights reserved.",
    "copyright": "Copyright <year> <holder>. All rights reserved.",
}
CUE = re.compile(r"licen[sc]|copyright|rights reserved|creative commons|free software|public domain|permission|redistribut|waived", re.IGNORECASE)
WORDS = re.compile(r"<[a-z]+>|\w+(?:[.\-]\w+)*", re.UNICODE)
#: Words a slot holds at most; least saving; most changed words, as a share of the template's (rounded down, but one where the template has over three words and no slot).
SLOT, LEAST_SAVING, MOST_CHANGED = 6, 0.15, 0.1
LEVEL = 3
#: Lines above a cue where a wording may begin; words before a wording in which `not` undoes it.
BEFORE, NOT = 3, 4


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words(text)
        self.slots = sum(w[0] == "<" for w in self.words)
        self.length = len(self.words) + self.slots * (SLOT - 1)
        # what a license number says is not open to change
        self.most = max(int(MOST_CHANGED * len(self.words)), int(len(self.words) > 3 and not self.slots))
        self.fixed = {w for w in self.words if any(c.isdigit() for c in w) or w in NAMES}
        plain = " ".join(w for w in self.words if w[0] != "<").encode()
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def changes(self, block: list[str]) -> tuple[int, int]:
        """(fewest words to change, words of the block used): the template against any beginning of the block."""
        far = 10**6
        more = [far if b in TELLING else 1 for b in block]
        row = [0, *accumulate(more)]
        for w in self.words:
            if w[0] == "<":
                row = [min(row[max(0, j - SLOT) : j], default=far) for j in range(len(row))]
                continue
            fixed = far if w in self.fixed else 1
            new = [row[0] + fixed]
            for j, b in enumerate(block, 1):
                new.append(min(row[j - 1] + (0 if b == w else fixed), row[j] + fixed, new[j - 1] + more[j - 1]))
            row = new
        best = min(row)
        return best, row.index(best)


# Words that tell one license from another.
NAMES = {"mit", "apache", "gnu", "mozilla", "mpl", "cc", "by", "by-sa", "by-nc", "attribution", "attribution-sharealike", "attribution-noncommercial", "unlicense", "not", "lesser", "affero", "eclipse"}
TELLING = NAMES - {"by"}  # nor may these come in
KNOWN = [Template(n, t) for n, t in TEMPLATES.items()]
_ALONE = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)


def savings(block: list[str]) -> list[tuple[float, Template]]:
    """Templates by how much smaller they make the block (of their own length), best first."""
    out = []
    for t in KNOWN:
        raw = " ".join(block[: t.length]).encode()
        alone = len(_ALONE.compress(raw))
        out.append((1 - len(t.packer.compress(raw)) / alone, t))
    return sorted(out, key=lambda x: -x[0])


@lru_cache(1 << 14)
def identify(block: tuple[str, ...]) -> tuple[str, int, int] | None:
    """(template, changed words, words used) of the license that begins the block."""
    best = None
    for saving, t in savings(list(block)):
        if saving < LEAST_SAVING:
            break
        changed, used = t.changes(list(block[: t.length]))
        if changed <= t.most:
            key = (-(len(t.words) - changed), changed)  # of several wordings that hold, the longest
            if best is None or key < best[0]:
                best = (key, (t.name, changed, used))
    return best and best[1]


LONGEST = max(t.length for t in KNOWN)
FIRST, SECOND = {t.words[0] for t in KNOWN}, {t.words[1] for t in KNOWN if len(t.words) > 3}
_SPDX = re.compile(r"SPDX-License-Identifier:\s*\(?([\w.+\-]+)", re.IGNORECASE)


def _regions(text: str) -> list[list[int]]:
    """Starts and ends of the lines around the cues."""
    out: list[list[int]] = []
    for cue in CUE.finditer(text):
        if out and cue.start() < out[-1][1]:
            continue
        lo = cue.start()
        for _ in range(BEFORE + 1):
            lo = text.rfind("\n", 0, max(0, lo))
            if lo < 0:
                break
        end = text.find("\n", cue.start())
        end = len(text) if end < 0 else end
        if out and lo < out[-1][1]:
            out[-1][1] = end
        else:
            out.append([lo + 1, end])
    return out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(template, changed words, place of its first word) of each license in the text."""
    hits = [(-100, 0, m.start(), m.end(), m[1].lower()) for m in _SPDX.finditer(text)]
    for lo, end in _regions(text):
        found = list(WORDS.finditer(text, lo, end))
        plain = [m[0].lower() for m in found]
        for i, w in enumerate(plain):
            if (w not in FIRST and (i + 1 == len(plain) or plain[i + 1] not in SECOND)) or "not" in plain[max(0, i - NOT) : i]:
                continue
            at = found[i].start()
            block = list(islice(WORDS.finditer(text, at), LONGEST))
            hit = identify(tuple(m[0].lower() for m in block))
            if hit:
                hits.append((hit[1] - hit[2], hit[1], at, block[min(hit[2], len(block)) - 1].end(), hit[0]))
    out: list[tuple[int, int, str, int]] = []
    for _, changed, at, end, name in sorted(hits):
        if all(end <= a or at >= b for a, b, _, _ in out):
            out.append((at, end, name, changed))
    return [(name, changed, at) for at, _, name, changed in sorted(out)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("license", pa.string()), ("changed", pa.int32()), ("at", pa.int32())])
    for batch in batches:
        found = [[{"license": a, "changed": b, "at": c} for a, b, c in scan(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], names=["doc_id", "found"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, found (license, changed words, place) of all rows; texts without a cue don't leave the JVM."""
    d = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    cue = F.coalesce(F.col("text").rlike("(?i)" + CUE.pattern), F.lit(False))
    kind = "array<struct<license:string,changed:int,at:int>>"
    rest = d.where(~cue).select("doc_id", F.array().cast(kind).alias("found"))
    return rest.union(d.where(cue).mapInArrow(_scan, f"doc_id long, found {kind}"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_documents(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.aggregate("found", F.lit(0), lambda a, x: a + x["changed"]), F.lit(0)).cast("long").alias("n_changed"))
