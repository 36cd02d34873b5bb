import numpy as np

from panelforge.llm.token_counts import by_section, count_tokens
from panelforge.llm.token_files import Encoder, vocabulary_path


def test_a_crossing_token_goes_where_most_of_it_lies():
    assert by_section(np.array([3, 5, 9]), np.array([2, 6, 9]))[0].tolist() == [1, 1, 1]
    assert by_section(np.array([4]), np.array([2, 4])) [0].tolist() == [1, 0]  # equal parts: the first
    assert by_section(np.array([9]), np.array([1, 3, 8, 9]))[0].tolist() == [0, 0, 1, 0]
    assert by_section(np.array([2, 4]), np.array([2, 4]))[1] == 0


def brute(text, encoder):
    """From the tokenizer's own offsets, in characters."""
    lines = text.splitlines(keepends=True) if text else []
    ends = np.cumsum([len(x) for x in lines]).tolist()
    out = [0] * len(lines)
    for a, b in encoder.tokenizer.encode(text, add_special_tokens=False).offsets:
        parts = [max(0, min(b, e) - max(a, s)) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        out[parts.index(max(parts))] += 1
    return out


def test_equals_the_tokenizers_offsets(spark):
    texts = ["one line", "two\nlines here\n", "a\n\n\nb  \n\n c\n", "été\nà la\nœuvre 日本\n", "x\n" * 200, "", None, "<|endoftext|>\nend"]
    e = Encoder(vocabulary_path())
    got = {r.doc_id: r for r in count_tokens(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")).collect()}
    for i, t in enumerate(texts):
        want = brute(t or "", e)
        assert list(got[i].section_tokens) == want and got[i].n_tokens == sum(want) and got[i].n_sections == len(want)


def test_own_sections(spark):
    df = spark.createDataFrame([(1, "title: body text here", [7])], "doc_id long, text string, cuts array<int>")
    r = count_tokens(df, sections="cuts").first()
    assert sum(r.section_tokens) == r.n_tokens and r.n_sections == 2


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
