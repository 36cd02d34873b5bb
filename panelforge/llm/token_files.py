"""Token ids as binary files, coded by canonical length-limited Huffman codes.

Encoding. The tokenizer splits a text by a rule before it looks for tokens. Texts are cut into pieces where that rule surely splits, as seen from the bytes on both sides: before white space; between letters, digits and marks; around one line feed between two characters. Where that isn't sure (other characters, rare white space, an apostrophe before a letter) there is no cut. So each piece is encoded by the tokenizer on its own, once for every 8 MB of texts in which it occurs, or not at all while a worker remembers it; ids of texts are put together from those of pieces by Arrow, without a step in Python for each piece. A worker remembers MEMORY pieces; those it has not met for half as many are forgotten. A text with a special token, or of a tokenizer with another rule, is one piece.

Codes. The counts of all ids are summed over the corpus; package-merge gives code lengths of at most LIMIT bits, canonical codes follow from the lengths. One table serves all files.

Between the two passes ids are kept as 16-bit numbers where the vocabulary allows it.

File format, little-endian: b"PFHC", version u32, documents u32, blocks u32, ids u64, payload bytes u64; doc_id i64 per document; ids u32 per document; bit offset u64 per block (a checkpoint every BLOCK ids); payload. A block is decoded by its offset alone, with a table of 2**LIMIT entries that gives id and length for the next bits; blocks are decoded side by side, one id of each at a time. Files are in ascending order of doc_id and so are the documents in each. They are rows of a Parquet table (part, data), since only Spark's writers reach every store.

Results in special cases: null text is empty and has the end id alone; a null doc_id comes first and is kept; rows that repeat a doc_id follow each other; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only, table

MAGIC, VERSION = b"PFHC", 1
#: Longest code, ids in a block, bytes of ids in a part, pieces that a worker remembers, bytes of text that are encoded at a time.
LIMIT, BLOCK, PART_BYTES, MEMORY, TEXT_BYTES = 20, 128, 8 << 20, 1_200_000, 8 << 20
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"


#: Ranges of doc_id, a task each: one for as many ids as a part has bytes until there are RANGES, then larger ones, of up to PARTS_A_RANGE times as many, so that a huge corpus doesn't need millions of tasks.
RANGES, PARTS_A_RANGE = 400, 16


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as bytes of little-endian numbers of type `kind`, by the tokenizer of a file."""

    SEPARATOR = b"<|endoftext|>"  # a special token: never part of a piece's ids
    SPACE = "Ġ"  # how a byte-level vocabulary writes a space
    #: A space and characters of one or two bytes, none of them white space (of two bytes, only U+0085 and U+00A0 are).
    PLAIN = re.compile(rb" (?:[!-~]|[\xc3-\xdf][\x80-\xbf])+")
    #: Longest piece that is remembered.
    LONGEST = 256

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.kind = id_kind(self.tokenizer.get_vocab_size(with_added_tokens=True))
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name[:1] == self.SPACE]] = True
        # the places where texts are cut are sure for this rule alone; texts of other tokenizers are pieces of their own
        rule = json.loads(self.tokenizer.to_str())
        split = rule["pre_tokenizer"] or {}
        added = [t["content"].encode() for t in rule["added_tokens"]]
        self.cuts = rule["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and added == [self.SEPARATOR] and not any(rule["added_tokens"][0][x] for x in ("single_word", "lstrip", "rstrip"))
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR.decode()) if self.cuts else None
        # ids of pieces; those not used since the half of the memory was last full
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _cut(self, parts: list[bytes], glue: bytes, first: Callable[[np.ndarray], np.ndarray], skip: int) -> Iterator[bytes]:
        """Ids of each part. They are encoded as one text; `first` says at which ids a part ends, `skip` how many of them are glue."""
        for lo in range(0, len(parts), 4096):
            ids = np.array(self.tokenizer.encode_batch_fast([glue.join(parts[lo : lo + 4096]).decode()], add_special_tokens=False)[0].ids, self.kind)
            raw, start, w = ids.tobytes(), 0, ids.itemsize
            for end in [*first(ids).tolist(), len(ids)]:
                yield raw[w * start : w * end]
                start = end + skip

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that all differ."""
        if len(self.known) > self.memory // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        out = [known.get(p) for p in pieces]
        plain: list[int] = []
        alone: list[int] = []
        for i, x in enumerate(out):
            if x is None:
                p = pieces[i]
                if (x := before.get(p)) is not None:
                    known[p] = out[i] = x
                elif self.separator is None or self.SEPARATOR in p:
                    out[i] = self.whole(p.decode())
                else:
                    (plain if self.PLAIN.fullmatch(p) else alone).append(i)
        # in pieces with one space, at their beginning, a token that begins with a space begins a piece
        for at, glue, first, skip in ((plain, b"", lambda ids: np.flatnonzero(self.spaced[ids])[1:], 0), (alone, self.SEPARATOR, lambda ids: np.flatnonzero(ids == self.separator), 1)):
            for i, x in zip(at, self._cut([pieces[i] for i in at], glue, first, skip) if at else (), strict=True):
                out[i] = x
                if len(pieces[i]) <= self.LONGEST:
                    known[pieces[i]] = x
        return out

    def _starts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin in the UTF-8 bytes of texts that follow each other; `ends` are the texts' offsets, 0 and the last end included."""
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts:
            kind = kinds(data)
            cut[1:-1] = BETWEEN[kind[:-1] << 3 | kind[1:]]
            # one line feed between two characters is a token of its own
            cut[2:-1] |= (kind[1:-1] == FEED) & SOLID[kind[:-2]] & SOLID[kind[2:]]
            raw, at = data.tobytes(), -1
            while (at := raw.find(self.SEPARATOR, at + 1)) >= 0:
                i = int(np.searchsorted(ends, at, "right"))
                cut[ends[i - 1] : ends[i]] = False
                at = int(ends[i]) - 1
        cut[ends] = True
        return np.flatnonzero(cut[:-1])

    def column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each text, and `end` behind them, as a column of binaries. Nulls are empty texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offs, data = texts.buffers()
        offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
        ends = offs - offs[0]
        starts = self._starts(data, ends)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        of = [*self._ids(pieces.dictionary.to_pylist()), end]
        at = np.searchsorted(starts, ends)
        order = np.insert(pieces.indices.to_numpy(zero_copy_only=False), at[1:], len(of) - 1)
        ids = pa.array(of, pa.large_binary()).take(pa.array(order))
        _, bounds, raw = ids.buffers()
        bounds = np.frombuffer(bounds, np.int64)[: len(ids) + 1][at + np.arange(len(at))]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(bounds)), raw])

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.column(pa.array(texts, pa.string())).to_pylist()


#: Kinds of bytes: white space, letter, digit, mark, other character, character that may be white space, apostrophe, line feed.
WHITE, LETTER, DIGIT, MARK, OTHER, UNSURE, QUOTE, FEED = range(8)


def _kinds_of_bytes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[:32] = out[127] = UNSURE
    out[33:127] = MARK
    out[[ord(c) for c in " \t\r"]] = WHITE
    out[[ord(c) for c in string.ascii_letters]] = LETTER
    out[[ord(c) for c in string.digits]] = DIGIT
    out[ord("'")], out[ord("\n")] = QUOTE, FEED
    return out


KINDS = _kinds_of_bytes()
#: Kinds that are surely no white space.
SOLID = np.isin(np.arange(8), (LETTER, DIGIT, MARK, OTHER, QUOTE))


def _between() -> np.ndarray:
    """By kind of a byte * 8 + kind of the next: whether a token surely ends between them."""
    out = np.zeros((8, 8), bool)
    out[np.ix_(SOLID, [WHITE, FEED])] = True
    known = [LETTER, DIGIT, MARK, QUOTE]
    for a in known:
        out[a, [b for b in known if b != a]] = True
    out[QUOTE, LETTER] = out[QUOTE, MARK] = out[MARK, QUOTE] = False
    return out.ravel()


BETWEEN = _between()


def kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte of UTF-8; all bytes of a character have its kind."""
    kind = KINDS[data]
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return kind
    after = lambda at, n: data[np.minimum(at + n, len(data) - 1)]
    byte = data[lead]
    two = lead[byte == 0xC3]
    two = two[~np.isin(after(two, 1), (0x97, 0xB7))]  # letters but for the signs of multiplication and division
    kind[two] = kind[two + 1] = LETTER
    space = lead[byte == 0xC2]
    space = space[np.isin(after(space, 1), (0x85, 0xA0))]
    kind[space] = kind[space + 1] = UNSURE
    # the general punctuation's, the ideographic, Ogham and Mongolian spaces
    at = lead[(byte >= 0xE1) & (byte <= 0xE3)]
    code = data[at].astype(np.uint32) << 16 | after(at, 1).astype(np.uint32) << 8 | after(at, 2)
    at = at[((code >= 0xE28080) & (code <= 0xE2808A)) | np.isin(code, (0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080, 0xE19A80, 0xE1A08E))]
    kind[at] = kind[at + 1] = kind[at + 2] = UNSURE
    return kind


def id_kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which remembers pieces from task to task."""
    return Encoder(path)


def groups(batch: pa.RecordBatch, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about `size` bytes of text in the second column; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _encoded(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        end = np.array([end_id], e.kind).tobytes()
        for batch in batches:
            for some in groups(batch):
                ids = e.column(some.column(1), end)
                n = np.diff(np.frombuffer(ids.buffers()[1], np.int64)) // len(end)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), ids.cast(pa.binary())], schema=schema)

    return run


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """All ids of a column of binaries, where Arrow has them."""
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(kind) if len(column) and offs[-1] > offs[0] else np.zeros(0, kind)


def _count_ids(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(_flat(batch.column(0), kind))
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    return run


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits; 0 for what doesn't occur. Huffman's lengths where they fit, else package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    weights = counts[used].tolist()
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, n = {}, len(weights)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = n
        heapq.heappush(heap, (a + b, n))
        n += 1
    depth = [0] * n
    for i in range(n - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    got = np.array(depth[: len(weights)])
    if got.max() > limit:
        order = np.argsort(counts[used], kind="stable")
        leaf = [(int(counts[used[i]]), np.array([k])) for k, i in enumerate(order)]
        row = leaf
        for _ in range(limit - 1):
            pairs = [(row[i][0] + row[i + 1][0], np.concatenate([row[i][1], row[i + 1][1]])) for i in range(0, len(row) - 1, 2)]
            row = list(heapq.merge(leaf, pairs, key=lambda x: x[0]))
        taken = np.bincount(np.concatenate([x[1] for x in row[: 2 * len(leaf) - 2]]), minlength=len(leaf))
        got[order] = taken
    lengths[used] = got
    return lengths


class Code:
    """Canonical codes of the lengths, and the table that decodes them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        used = used[np.lexsort((used, self.lengths[used]))]
        self.codes = np.zeros(len(lengths), np.uint64)
        spans = np.int64(1) << (self.bits - self.lengths[used])
        starts = np.concatenate([[0], np.cumsum(spans)])[:-1]
        self.codes[used] = (starts >> (self.bits - self.lengths[used])).astype(np.uint64)
        self.table_id = np.zeros(1 << self.bits, np.uint32)
        self.table_length = np.ones(1 << self.bits, np.uint8)
        self.table_id[: spans.sum()] = np.repeat(used, spans)
        self.table_length[: spans.sum()] = np.repeat(self.lengths[used], spans)

    def encode(self, ids: np.ndarray, piece: int = 1 << 15) -> tuple[np.ndarray, bytes]:
        """(bit offset of each block, the bits). First bits are the highest of a byte. Works on `piece` ids at a time, which stay in the processor's cache."""
        total = int(self.lengths[ids].sum()) if len(ids) else 0
        words = np.zeros((total + 63) // 64 + 1, np.uint64)
        offsets, base = [], 0
        for lo in range(0, len(ids), piece):
            some = ids[lo : lo + piece]
            n, code = self.lengths[some], self.codes[some]
            ends = np.cumsum(n)
            ends += base
            starts = ends - n
            base = int(ends[-1])
            at = starts >> 6
            room = 64 - (starts & 63) - n  # bits left in the word; below 0 the code runs on into the next
            over = np.flatnonzero(room < 0)
            high = code << np.maximum(room, 0).astype(np.uint64)
            high[over] = code[over] >> (-room[over]).astype(np.uint64)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[first]] |= np.bitwise_or.reduceat(high, first)
            words[at[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
            offsets.append(starts[-lo % BLOCK :: BLOCK])
        return np.concatenate(offsets or [np.zeros(0)]).astype(np.uint64), words.astype(">u8").tobytes()[: (total + 7) // 8]

    def decode(self, offsets: np.ndarray, payload: bytes, count: int) -> np.ndarray:
        """The ids. Every block is read by its offset alone."""
        raw = np.frombuffer(payload + bytes(16 + -len(payload) % 8), ">u8").astype(np.uint64)
        out = np.zeros((len(offsets), BLOCK), np.uint32)
        pos = offsets.astype(np.int64).copy()
        shift = np.uint64(64 - self.bits)
        last = len(offsets) - 1
        for j in range(min(BLOCK, count)):
            if last * BLOCK + j == count:  # the last block is shorter
                pos = pos[:last]
            word, into = pos >> 6, (pos & 63).astype(np.uint64)
            peek = (raw[word] << into) | ((raw[word + 1] >> np.uint64(1)) >> (np.uint64(63) - into))
            peek >>= shift
            out[: len(pos), j] = self.table_id[peek]
            pos = pos + self.table_length[peek]
        return out.reshape(-1)[:count]


def write_part(code: Code, doc_ids: list, raw: list[bytes], kind: str = "<u4") -> bytes:
    ids = np.frombuffer(b"".join(raw), kind)
    offsets, payload = code.encode(ids)
    null = [i for i, x in enumerate(doc_ids) if x is None]
    head = MAGIC + struct.pack("<IIIQQI", VERSION, len(raw), len(offsets), len(ids), len(payload), len(null))
    parts = (np.array([x or 0 for x in doc_ids], "<i8"), np.array([len(x) // ids.itemsize for x in raw], "<u4"), np.array(null, "<u4"), offsets.astype("<u8"))
    return head + b"".join(x.tobytes() for x in parts) + payload


def read_part(code: Code, data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, its ids) of a part."""
    if data[:4] != MAGIC:
        raise ValueError("not a file of token ids")
    version, docs, blocks, ids, size, nulls = struct.unpack_from("<IIIQQI", data, 4)
    if version != VERSION:
        raise ValueError(f"version {version}")
    at = 4 + struct.calcsize("<IIIQQI")
    fields = []
    for kind, n in (("<i8", docs), ("<u4", docs), ("<u4", nulls), ("<u8", blocks)):
        fields.append(np.frombuffer(data, kind, n, at))
        at += fields[-1].nbytes
    doc_ids = fields[0].tolist()
    for i in fields[2].tolist():
        doc_ids[i] = None
    all_ids = code.decode(fields[3], data[at : at + size], ids)
    ends = np.cumsum(fields[1]).tolist()
    start = 0
    for d, end in zip(doc_ids, ends, strict=True):
        yield d, all_ids[start:end]
        start = end


@cache
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


def _written(lengths, kind: str):
    width = np.dtype(kind).itemsize
    schema = pa.schema([("part", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, docs, raw, size = _code(lengths.value), TaskContext.get().partitionId(), [], [], 0
        number = 0

        def out():
            data = write_part(code, docs, raw, kind)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array(docs[:1], pa.int64()), pa.array([size // width], pa.int64()), pa.array([data], pa.binary())], schema=schema)

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = x.as_py()
                if raw and size + len(x) > PART_BYTES:
                    yield out()
                    docs, raw, size, number = [], [], 0, number + 1
                docs.append(d)
                raw.append(x)
                size += len(x)
        if raw:
            yield out()

    return run


def _read(lengths):
    schema = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("inside", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(lengths.value)
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, inside = [], 0
                for i, (d, ids) in enumerate(read_part(code, data.as_py())):
                    rows.append((part, i, d, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), inside))
                    inside += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, bytes]:
    """Encode the documents into a table of parts at path: (part, first, n_ids, data). Returns it with the lengths of the codes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path_ = vocabulary or vocabulary_path()
    kind = Encoder(path_).kind
    ids = scratch.save(d.mapInArrow(_encoded(path_, end_id), "doc_id long, n long, ids binary"), "ids")
    total = ids.agg(F.sum("n")).first()[0] or 0
    counts = ids.select("ids").mapInArrow(_count_ids(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the vocabulary has ids
    of = np.zeros(int(max(counts["id"].to_pylist(), default=0)) + 1, np.int64)
    of[counts["id"].to_numpy()] = counts["n"].to_numpy()
    lengths = code_lengths(of).astype(np.uint8).tobytes()
    code = spark.sparkContext.broadcast(lengths)
    parts = max(1, min(round(total / PART_BYTES), RANGES), round(total / (PARTS_A_RANGE * PART_BYTES)))
    ordered = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).select("doc_id", "ids")
    ordered.mapInArrow(_written(code, kind), "part long, first long, n_ids long, data binary").write.option("compression", "none").parquet(path)
    return spark.read.parquet(path), lengths


def read_back(files: DataFrame, lengths: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    spark = files.sparkSession
    from pyspark.sql.window import Window

    code = spark.sparkContext.broadcast(lengths)
    # ids in the parts before: one row a part of PART_BYTES, added up by groups of parts
    sums = files.select("part", "n_ids", F.shiftright("part", 32).alias("g"))
    groups = sums.groupBy("g").agg(F.sum("n_ids").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = sums.join(groups.select("g", "base"), "g").withColumn("base", F.col("base") + F.coalesce(F.sum("n_ids").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    rows = files.select("part", "data").mapInArrow(_read(code), "part long, at long, doc_id long, n_tokens long, ids_crc32 long, inside long")
    return rows.join(before, "part").select("doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame) -> DataFrame:
    files, lengths = write(docs, Scratch(docs.sparkSession, "files").path("tokens"))
    return read_back(files, lengths)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files of the documents."""
    return encode_documents(docs)
