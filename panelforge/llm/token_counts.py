"""Token counts by section, from one encoding of each whole document.

Ids of a byte-level vocabulary stand for fixed numbers of bytes, so the running sum of those numbers gives the span of each token in the text. Spans are joined to the sections of the text, which are intervals too, by searching the section of a token's first and last byte. A token that lies in several sections counts for the one that holds most of its bytes, the earliest of equals, and is reported as crossing. Counts of the sections therefore add up to the count of the document, which encoding each section on its own does not give.

A section is a line with the line feed that ends it; a column of own sections (ends in bytes, ascending) may be given instead.

Results in special cases: null and empty texts have no tokens and no sections; rows that repeat a doc_id each get their row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table
from .token_files import Encoder, encoder, vocabulary_path


def token_bytes(encoder: Encoder) -> np.ndarray:
    """How many bytes each id stands for: in a byte-level vocabulary, every character of a token's name is a byte; a special token is its own text."""
    names = encoder.tokenizer.get_vocab(with_added_tokens=True)
    special = {x.content for x in encoder.tokenizer.get_added_tokens_decoder().values()}
    out = np.zeros(max(names.values()) + 1, np.int64)
    for name, i in names.items():
        out[i] = len(name.encode()) if name in special else len(name)
    return out


def by_section(spans_end: np.ndarray, section_end: np.ndarray) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross). Both ends ascend; the last section ends where the last token does."""
    start = np.concatenate([[0], spans_end[:-1]])
    first = np.searchsorted(section_end, start, "right")
    last = np.searchsorted(section_end, spans_end - 1, "right")
    own = first.copy()
    cross = np.flatnonzero(last > first)
    for t in cross.tolist():
        edges = np.clip(section_end[first[t] : last[t] + 1], start[t], spans_end[t])
        own[t] = first[t] + int(np.argmax(np.diff(np.concatenate([[start[t]], edges]))))
    return np.bincount(own, minlength=len(section_end)), len(cross)


def _counts(path: str, own_sections: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("section_tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        size = token_bytes(e)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                rows = []
                for i, (text, ids) in enumerate(zip(texts, e.encode(texts), strict=True)):
                    ends = np.cumsum(size[np.frombuffer(ids, e.kind)])
                    raw = np.frombuffer(text.encode(), np.uint8)
                    if len(ends) and ends[-1] != len(raw):
                        raise ValueError("the vocabulary does not cover the bytes of a text")
                    cuts = np.array(some.column(2)[i].as_py() or [], np.int64) if own_sections else np.flatnonzero(raw == 0x0A) + 1
                    cuts = cuts[cuts < len(raw)]
                    cuts = np.append(cuts, len(raw)) if len(raw) else cuts
                    n, cross = by_section(ends, cuts) if len(ends) else (np.zeros(0, np.int64), 0)
                    rows.append((len(ends), len(cuts), cross, n.tolist()))
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return run


def count_tokens(docs: DataFrame, vocabulary: str | None = None, sections: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens of all rows. sections: a column of section ends in bytes."""
    d = only(docs, "doc_id", "text", *([sections] if sections else []))
    d = d.withColumn("doc_id", F.col("doc_id").cast("long"))
    return d.mapInArrow(_counts(vocabulary or vocabulary_path(), sections is not None), "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("section_tokens", F.array_join("section_tokens", ","))
