import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm.token_files import BLOCK, Code, Encoder, code_lengths, encode_documents, groups, read_part, vocabulary_path, write_part


def test_codes_are_optimal_where_the_limit_allows():
    counts = np.array([5, 0, 9, 12, 13, 16, 45])
    n = code_lengths(counts, 10)
    assert (counts * n).sum() == 224 and n[1] == 0


@pytest.mark.parametrize("limit", [9, 12, 20])
def test_codes_keep_the_limit_and_come_back(limit):
    rng = np.random.default_rng(limit)
    counts = (1e9 / np.arange(1, 401) ** 3.0).astype(np.int64) + 1
    n = code_lengths(counts, limit)
    assert n.max() <= limit and sum(2.0**-x for x in n) <= 1
    code = Code(n)
    for size in (0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 40_001):
        ids = rng.integers(0, 400, size).astype(np.uint32)
        offsets, bits = code.encode(ids)
        assert (code.decode(offsets, bits, size) == ids).all()
    ids = rng.integers(0, 400, 1000).astype(np.uint32)
    offsets, bits = code.encode(ids)
    assert (code.decode(offsets[3:4], bits, BLOCK) == ids[3 * BLOCK : 4 * BLOCK]).all()  # one block alone


def test_a_single_id():
    code = Code(code_lengths(np.array([0, 0, 7])))
    offsets, bits = code.encode(np.full(300, 2, np.uint32))
    assert (code.decode(offsets, bits, 300) == 2).all()


def test_parts_come_back():
    docs, raw = [None, 3, 3, 9], [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 200, 1)]
    code = Code(code_lengths(np.ones(200, np.int64)))
    back = list(read_part(code, write_part(code, docs, raw)))
    assert [d for d, _ in back] == docs and [x.astype("<u4").tobytes() for _, x in back] == raw


ODD = ["", " ", "  ", " a", "a ", "a  b", "\n a", "a \n b", "x\t y \t z", "a　 b", "a 　b", "q<|endoftext|> r <|endoftext|>", "don't they'll  ", "\n\n  \n x", "é" * 50, "many words " * 3000]


def test_pieces_give_what_the_whole_text_gives():
    e = Encoder(vocabulary_path(), memory=50)
    assert e.encode(ODD) == [e.whole(t) for t in ODD] == e.encode(ODD)


def test_thousands_of_texts_of_all_kinds_of_characters():
    rng = random.Random(9)
    space = [" ", " ", " ", " ", " ", "\n", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "\u200b", "  ", "\n\n"]
    words = ["the", "The", "it's", "they'll", "don't,", "x'", "(a)", "end.", "end...", "#$%", "a-b", "3.14", "v2", "é", "ñandú!", "Дом", "日本", "語。", "ǅ", "ª", "²", "_", "a_b", "\u0120", "\u0301", "😀", "<|endoftext|>", "<|", "|>", "a,b", "'s", "'", ".s", "ſ"]
    letters = "abcdeéñÀZ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
    texts = ["".join((rng.choice(words) if rng.random() < 0.4 else word()) + (rng.choice(space) if rng.random() < 0.9 else "") for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    for memory in (60, 2000, 1_000_000):
        e = Encoder(vocabulary_path(), memory=memory)
        assert e.encode(texts) == [e.whole(t) for t in texts]


def test_short_texts_of_every_kind_of_byte():
    """All texts of up to four characters from one or two of each kind, next to each other in one column."""
    e = Encoder(vocabulary_path())
    texts = ["".join(x) for n in range(5) for x in itertools.product("as1.' \n\té\u00a0\u3000", repeat=n)]
    assert e.encode(texts) == [bytes(np.array(x.ids, e.kind).data) for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_a_tokenizer_with_another_rule_gets_whole_texts():
    e = Encoder(vocabulary_path("word_bpe_49k.json"))
    texts = ["Two words, 12 and a'b\n\n c", "", "x  y"] * 3
    assert e.encode(texts) == [e.whole(t) for t in texts]


def test_columns_with_nulls_and_offsets():
    e = Encoder(vocabulary_path())
    column = pa.array(["left out", "a b", None, "", "c. d<|endoftext|>", "<|endoftext|>e f"])[1:]
    end = np.array([2], e.kind).tobytes()
    assert e.column(column, end).to_pylist() == [e.whole(t or "") + end for t in column.to_pylist()]
    batch = pa.record_batch([pa.array(range(5)), column], names=["doc_id", "text"])
    assert [g.column(0).to_pylist() for g in groups(batch, 4)] == [[0, 1, 2], [3], [4]]
    assert list(groups(batch[:0])) == []


def test_documents_come_back_from_the_files(spark):
    rows = [(i * 7 % 31, t) for i, t in enumerate(ODD)] + [(40, None), (2, "twice"), (2, "twice"), (None, "no id")]
    e = Encoder(vocabulary_path())
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.frombuffer(e.whole(t or "") + np.array([2], e.kind).tobytes(), e.kind).astype("<u4").tobytes()
        want.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    df = encode_documents(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int"))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
