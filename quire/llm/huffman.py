"""Token ids as canonical length-limited Huffman blocks with bit-offset checkpoints.

File format: a Parquet container of blocks that decode independently of one another, in the order
(shard, block). A block holds consecutive documents in ascending doc_id order:

    magic "QHB1" | u32 documents | u64 ids of all documents before the block | u32 checkpoint spacing
    per document: i64 doc_id, u64 ids, u8 doc_id is null  (three arrays)
    u32 checkpoints | u64 bit offset of every ``spacing``-th id (array) | bit stream, most significant bit first

The code book is a table of (id, code length); canonical codes follow from the lengths alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, materialize, shared_folder
from .tokens import encode_each, tokenizer_path

END_ID = 0
MAX_LENGTH = 18
BLOCK_IDS = 1 << 17
SPACING = 128
MAGIC = b"QHB1"


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code length of every symbol (0 where its count is 0) under ``limit``, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64 if counts.sum() > 1 << 52 else np.int64)
    n = len(order)
    levels: list[np.ndarray] = []  # of each list, after merging: which entries are packages
    packages = np.empty(0, weight.dtype)
    for _ in range(limit):
        every = np.concatenate([weight, packages])
        rank = np.argsort(every, kind="stable")
        levels.append(rank >= n)
        merged = every[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    depth, take = np.zeros(n, np.int64), 2 * n - 2
    for is_package in reversed(levels):
        chosen = int(is_package[:take].sum())
        depth[: take - chosen] += 1
        take = 2 * chosen
    out[order] = depth
    return out


@dataclass
class CodeBook:
    """Canonical codes for ``lengths``; a decoding table of 2^limit entries."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.limit = max(1, int(self.lengths.max(initial=1)))
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        length = self.lengths[order].astype(np.int64)
        span = np.left_shift(np.int64(1), self.limit - length)
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = (first >> (self.limit - length)).astype(np.uint64)
        self.aligned = self.codes << (np.uint64(64) - np.maximum(self.lengths, 1).astype(np.uint64))
        self.wide = self.lengths.astype(np.uint64)
        self.symbols = np.zeros(1 << self.limit, np.uint32)
        filled = np.repeat(order.astype(np.uint32), span)
        self.symbols[: len(filled)] = filled
        self.widths = self.lengths[self.symbols].astype(np.uint64)

    def encode(self, ids: np.ndarray, spacing: int = SPACING) -> tuple[np.ndarray, bytes]:
        """(checkpoints, bit stream)."""
        if not len(ids):
            return np.empty(0, np.uint64), b""
        length = self.wide[ids]
        end = np.cumsum(length)
        start = end - length
        word = start >> np.uint64(5)
        # A code of at most 32 bits that starts in a 32-bit word ends in the 64 bits from there.
        part = self.aligned[ids] >> (start & np.uint64(31))
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        stream = np.zeros(int(word[-1]) + 2, np.uint64)
        both = np.bitwise_or.reduceat(part, first)
        stream[word[first]] = both >> np.uint64(32)
        stream[word[first] + np.uint64(1)] |= both & np.uint64(0xFFFFFFFF)
        return start[::spacing], stream.astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8]

    def decode(self, n: int, checkpoints: np.ndarray, stream: bytes, spacing: int = SPACING) -> np.ndarray:
        """All n ids; every checkpoint's run is a lane of one vectorised table look-up."""
        if not n:
            return np.empty(0, np.uint32)
        data = np.frombuffer(stream + bytes(12), np.uint8)
        at = checkpoints.astype(np.uint64).copy()
        lanes = len(at)
        out = np.zeros((spacing, lanes), np.uint32)
        mask = np.uint64((1 << self.limit) - 1)
        big = data[:-3].astype(np.uint64)
        big = (big << np.uint64(24)) | (data[1:-2].astype(np.uint64) << np.uint64(16)) | (data[2:-1].astype(np.uint64) << np.uint64(8)) | data[3:]
        shift = np.uint64(32 - self.limit)
        last = n - (lanes - 1) * spacing
        for step in range(min(spacing, n)):
            if step == last and lanes > 1:
                at = at[:-1]
            elif step >= last and lanes == 1:
                break
            code = (big[at >> np.uint64(3)] >> (shift - (at & np.uint64(7)))) & mask
            out[step, : len(at)] = self.symbols[code]
            at = at + self.widths[code]
        return out.T.reshape(-1)[:n]


def pack_block(book: CodeBook, first: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, spacing: int = SPACING) -> bytes:
    checkpoints, stream = book.encode(ids, spacing)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(
        [
            MAGIC, struct.pack("<IQI", len(doc_ids), first, spacing), known.tobytes(), sizes.astype("<u8").tobytes(), nulls.tobytes(),
            struct.pack("<I", len(checkpoints)), checkpoints.astype("<u8").tobytes(), stream
        ]
    )


def unpack_block(book: CodeBook, block: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(ids before the block, doc_ids, ids of each document, all ids)."""
    if block[:4] != MAGIC:
        raise ValueError("not a block")
    n, first, spacing = struct.unpack_from("<IQI", block, 4)
    at = 20
    known = np.frombuffer(block, "<i8", n, at)
    sizes = np.frombuffer(block, "<u8", n, at + 8 * n).astype(np.int64)
    nulls = np.frombuffer(block, np.uint8, n, at + 16 * n)
    at += 17 * n
    (count,) = struct.unpack_from("<I", block, at)
    checkpoints = np.frombuffer(block, "<u8", count, at + 4)
    ids = book.decode(int(sizes.sum()), checkpoints, block[at + 4 + 8 * count :], spacing)
    return first, [None if z else d for d, z in zip(known.tolist(), nulls.tolist(), strict=True)], sizes, ids


def _raw_blocks(docs: DataFrame, path: str) -> DataFrame:
    """Documents in ascending order, tokenised, as rows of consecutive documents; the shard is the range partition."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, ordered.rdd.getNumPartitions())
    # Bounds come from the id column alone; a range partitioner would read every text for its sample.
    bounds = sorted(
        set(docs.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))
    ) if n > 1 else []
    ordered = ordered.repartitionById(n, F.coalesce(_range_of(F.col("doc_id"), bounds), F.lit(0)).cast("int")).sortWithinPartitions("doc_id", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        docs_, sizes, raws, held = [], [], [], 0
        end, total = END_ID.to_bytes(4, "little"), np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            nonlocal total
            wide = np.frombuffer(b"".join(raws), "<u4")
            total = _added(total, np.bincount(wide))
            narrow = wide.max(initial=0) < 1 << 16
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                    pa.array([docs_], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([held], pa.int64()),
                    pa.array([2 if narrow else 4], pa.int32()), pa.array([wide.astype("<u2" if narrow else "<u4").tobytes()], pa.binary())
                ],
                ["shard", "block", "before", "docs", "sizes", "n", "width", "ids"],
            )

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode_each((x.as_py() for x in batch.column(1)), path), strict=True):
                raw += end
                docs_.append(doc_id)
                sizes.append(len(raw) // 4)
                raws.append(raw)
                held += len(raw) // 4
                if held >= BLOCK_IDS:
                    yield flush()
                    block, before = block + 1, before + held
                    docs_, sizes, raws, held = [], [], [], 0
        if docs_:
            yield flush()
        if len(total):  # the counts of the shard, bounded by the vocabulary
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([-1], pa.int32()), pa.array([0]), pa.array([[]], pa.list_(pa.int64())),
                    pa.array([[]], pa.list_(pa.int64())), pa.array([0]), pa.array([8], pa.int32()), pa.array([total.tobytes()], pa.binary())
                ],
                ["shard", "block", "before", "docs", "sizes", "n", "width", "ids"]
            )

    return ordered.mapInArrow(of, "shard int, block int, before long, docs array<long>, sizes array<long>, n long, width int, ids binary")


def _range_of(value, bounds: list[float]):
    """How many of the sorted bounds are at most ``value``: first among every ``step``-th, then between two of those."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[at : at + step] for at in range(0, len(bounds), step)]
    up_to = lambda array: F.size(F.filter(array, lambda b: b <= value))
    run = up_to(F.lit([r[0] for r in runs]))
    return F.when(run > 0, (run - 1) * step + up_to(F.element_at(F.array(*[F.lit(r) for r in runs]), run))).otherwise(0)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two count tables of any lengths."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    out = a.astype(np.int64)
    out[: len(b)] += b
    return out


def _ids(width: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4")


def write_ids(docs: DataFrame, folder: str, path: str | None = None, limit: int = MAX_LENGTH) -> None:
    """Tokenise ``docs`` and write ``folder``/blocks and ``folder``/codebook.

    An id 0 ends every document; null and empty texts are that id alone. Documents go in ascending
    doc_id order, null ids first, rows of equal id by text. Rows that repeat are all written. Counts cover all ids;
    the code book is bounded by the vocabulary and the start of every block by one number a shard.
    """
    spark = docs.sparkSession
    both = materialize(_raw_blocks(docs, path or tokenizer_path()), "id-blocks")
    raw = both.where("block >= 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for content in batch.column(0).to_pylist():
                total = _added(total, np.frombuffer(content, np.int64))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    counted = both.where("block < 0").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id long, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    totals, starts = raw.groupBy("shard").agg(F.sum("n").alias("n")).collect(), {}  # one row a range partition
    at = 0
    for row in sorted(totals):
        starts[row.shard] = at
        at += row.n
    shared = spark.sparkContext.broadcast((CodeBook(lengths).lengths, starts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = CodeBook(shared.value[0])
        for batch in batches:
            shard, block, before, docs_, sizes, _, width, ids = (c.to_pylist() for c in batch.columns)
            done = [
                pack_block(book, shared.value[1][s] + b, d, np.array(z, np.int64), _ids(w, i)) for s, b, d, z, w,
                i in zip(shard, before, docs_, sizes, width, ids, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.binary())], ["shard", "block", "content"])

    raw.mapInArrow(encode, "shard int, block int, content binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) decoded from the files; start counts the ids of all documents before."""
    table = spark.read.schema("id long, length int").parquet(f"{folder}/codebook").toPandas()  # bounded by the vocabulary
    lengths = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.uint8)
    lengths[table["id"].to_numpy(np.int64)] = table["length"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(lengths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = CodeBook(shared.value)
        for batch in batches:
            for content in batch.column(0):
                first, docs_, sizes, ids = unpack_block(book, content.as_py())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                cut = [raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs_, pa.int64()), pa.array(first + ends - sizes), pa.array(sizes),
                        pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                        pa.array([bytes(c) for c in cut] if with_ids else [None] * len(cut), pa.binary())
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    blocks = spark.read.schema("shard int, block int, content binary").parquet(f"{folder}/blocks").select("content")
    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written and read back; edge cases as of ``write_ids``."""
    import uuid

    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), folder)
    return read_ids(spark, folder, with_ids=False).drop("ids")
