"""Line deduplication across documents with a once-seen and a twice-seen Bloom filter.

1. Every batch of documents sends the sorted 64-bit hashes of its distinct line keys, cut by hash range.
2. Each range streams its fragments through two Bloom filters: a hash found in the first goes to the
   second. Only the second, twice-seen filter is returned; its size is bounded by ``MAX_FILTER_BITS``.
3. Documents probe that filter; only lines it suspects are shuffled, as text, to confirm that two
   documents hold them and to choose the smallest doc_id.
4. Only documents with a suspected line are shuffled, to meet the lines that they lose; all others pass through.

A filter past its capacity only suspects more lines; the outcome never depends on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extended, map_rows, materialize, utf8

MIN_LENGTH = 10
HASHES = 4
CHARS_PER_RANGE = 1 << 24
MAX_RANGES = 4096
MAX_FILTER_BITS = 1 << 29
"""Of the whole twice-seen filter: 64 MiB, the most that is ever broadcast."""


ADDED = "kept_text string, n_lines long, n_dropped long"


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of every line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip() for line in (text or b"").lower().split(b"\n")]


def long_enough(key: bytes) -> bool:
    n = len(key)
    return n >= MIN_LENGTH and (n >= 4 * MIN_LENGTH or key.isascii() or len(key.decode()) >= MIN_LENGTH)


def _hashes(keys: set[bytes]) -> list[int]:
    h = xxhash.xxh3_64_intdigest
    return [h(k) for k in keys]


def _positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions of double hashing; ``bits`` is a power of two."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(20)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(bits - 1)) for i in range(HASHES)]


def _has(filter_bytes: np.ndarray, at: list[np.ndarray], base: np.ndarray | int = 0) -> np.ndarray:
    out = np.ones(len(at[0]), bool)
    for p in at:
        p = p + np.uint64(0) if isinstance(base, int) else p + base
        out &= (filter_bytes[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _put(filter_bytes: np.ndarray, at: list[np.ndarray]) -> None:
    for p in at:
        np.bitwise_or.at(filter_bytes, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


def _power(n: float) -> int:
    return 1 << max(10, int(np.ceil(np.log2(max(n, 1)))))


def _fragments(docs: DataFrame, range_bits: int) -> DataFrame:
    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[int] = []
        for text in utf8(batch.column(0)):
            found += _hashes({k for k in line_keys(text) if long_enough(k)})
        h, n = np.unique(np.array(found, np.uint64), return_counts=True)
        part = (h >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(h), np.int64)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(h) else np.empty(0, np.int64)
        ends = np.r_[cut[1:], len(h)] if len(h) else cut
        rows = [(int(part[a]), int(b - a), h[a:b].tobytes(), np.packbits(n[a:b] > 1).tobytes()) for a, b in zip(cut, ends, strict=True)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["part", "n", "hashes", "twice"])

    return map_rows(docs.where("doc_id is not null and text is not null").select("text"), of, "part int, n long, hashes binary, twice binary")


def twice_seen(docs: DataFrame):
    """Broadcast of (bits of a range, filter bytes, range bits): a superset of the keys that two documents hold."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = min(MAX_RANGES, _power(max(1, chars / CHARS_PER_RANGE) * 16) // 16)
    range_bits = max(0, int(np.log2(max(1, ranges))))
    ranges = 1 << range_bits
    fragments = materialize(_fragments(docs, range_bits), "line-fragments")
    most = fragments.groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    once_bits, twice_bits = _power(10 * most), min(MAX_FILTER_BITS // ranges, _power(5 * most))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, once, twice = None, None, None
        for batch in batches:
            for p, n, hashes, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if part is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["part", "bytes"])
                    part, once, twice = p, np.zeros(once_bits // 8, np.uint8), np.zeros(twice_bits // 8, np.uint8)
                h = np.frombuffer(hashes, np.uint64)
                at = _positions(h, once_bits)
                again = _has(once, at) | np.unpackbits(np.frombuffer(marks, np.uint8), count=n).astype(bool)
                _put(once, at)
                _put(twice, _positions(h[again], twice_bits))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["part", "bytes"])

    filters = fragments.repartition("part").sortWithinPartitions("part").mapInArrow(build, "part int, bytes binary")
    whole = np.zeros(ranges * twice_bits // 8, np.uint8)
    for part, content in filters.toLocalIterator():  # at most MAX_FILTER_BITS together
        whole[part * twice_bits // 8 : (part + 1) * twice_bits // 8] = np.frombuffer(content, np.uint8)
    return spark.sparkContext.broadcast((twice_bits, whole, range_bits))


def _hits(texts: list[bytes | None], table: tuple) -> tuple[list[bytes], list[int], list[int]]:
    """(keys, their texts, which of them the twice-seen filter has) of the distinct keys of each text."""
    bits, whole, range_bits = table
    keys, h, owner = [], [], []
    for i, text in enumerate(texts):
        own = {k for k in line_keys(text) if long_enough(k)}
        keys += own
        h += _hashes(own)
        owner += [i] * len(own)
    hashes = np.array(h, np.uint64)
    base = (hashes >> np.uint64(64 - range_bits)) * np.uint64(bits) if range_bits else np.zeros(len(hashes), np.uint64)
    return keys, owner, np.flatnonzero(_has(whole, _positions(hashes, bits), base)).tolist()


def _suspects(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, key) of every line that the filter suspects."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owner, hit = _hits(utf8(batch.column(1)), shared.value)
        ids = batch.column(0).take(pa.array([owner[i] for i in hit], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array([keys[i] for i in hit], pa.binary()).cast(pa.string())], ["doc_id", "key"])

    return map_rows(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, "doc_id long, key string")


def _marked(docs: DataFrame, shared) -> DataFrame:
    """``docs`` with __suspect: has a document of a doc_id a line that the filter suspects?"""
    names = docs.columns
    text_at, id_at = names.index("text"), names.index("doc_id")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, owner, hit = _hits(utf8(batch.column(text_at)), shared.value)
        marks = np.zeros(batch.num_rows, bool)
        marks[[owner[i] for i in hit]] = True
        marks &= batch.column(id_at).is_valid().to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], [*names, "__suspect"])

    return map_rows(docs, of, extended(docs, "__suspect boolean"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Every row and column of ``docs``, with kept_text, n_lines (before dropping) and n_dropped.

    A key of at least ten code points that two different doc_ids hold stays only in the smallest of
    them, on every line of it there. Null or empty text is one empty line. Rows of a null doc_id neither
    lose lines nor make another document lose any. Rows that repeat a doc_id count as one document.
    Input columns named kept_text, n_lines or n_dropped are replaced. An empty table stays empty.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    names, shared = docs.columns, twice_seen(docs)
    suspects = materialize(_suspects(docs, shared), "line-suspects")
    several = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    owners = materialize(several.select("key", "first"), "line-owners")
    lost = suspects.join(owners, "key").where("doc_id != first").groupBy("doc_id").agg(F.collect_set("key").alias("__lost"))
    marked = _marked(docs, shared)
    whole = marked.where(~F.col("__suspect")).select(*names)
    n_lines = F.length("kept_text") - F.length(F.replace("kept_text", F.lit("\n"), F.lit(""))) + 1
    whole = whole.withColumn("kept_text", F.coalesce("text", F.lit(""))).withColumn("n_lines", n_lines.cast("long")).withColumn("n_dropped", F.lit(0).cast("long"))
    both = marked.where("__suspect").join(lost.withColumnRenamed("doc_id", "__doc"), F.col("doc_id") == F.col("__doc"), "left")
    return whole.unionByName(_kept_lines(both.select(*names, "__lost"), docs))


def _kept_lines(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with their lost keys, an array or null, in the last column."""
    names = docs.columns
    text_at, lost_at = names.index("text"), len(names)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone = [{k.encode() for k in keys} if keys else None for keys in batch.column(lost_at).to_pylist()]
        return _cut(batch.select(names), batch.column(text_at), gone)

    return map_rows(rows, keep, extended(docs, ADDED))


def _cut(batch: pa.RecordBatch, texts: pa.Array, gone: list[set[bytes] | None]) -> pa.RecordBatch:
    """The batch with kept_text, n_lines and n_dropped, without the lines whose keys are ``gone``."""
    kept, lines, dropped = [], [], []
    for text, out in zip(utf8(texts), gone, strict=True):
        text = text or b""
        n = text.count(b"\n") + 1
        if out:
            stay = [line for line, key in zip(text.split(b"\n"), line_keys(text), strict=True) if key not in out]
            dropped.append(n - len(stay))
            text = b"\n".join(stay)
        else:
            dropped.append(0)
        kept.append(text)
        lines.append(n)
    more = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "kept_text", "n_lines", "n_dropped"])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that another one holds first; edge cases as of ``dedup_lines``."""
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """The same result for small tables of distinct ids, by dictionaries."""
    holders: dict[bytes, set[int]] = {}
    for doc_id, text in rows:
        for key in line_keys((text or "").encode()):
            if len(key.decode()) >= MIN_LENGTH:
                holders.setdefault(key, set()).add(doc_id)
    out = {}
    for doc_id, text in rows:
        content = (text or "").encode()
        lines = content.split(b"\n")
        stay = [line for line, key in zip(lines, line_keys(content), strict=True) if len(holders.get(key, ())) < 2 or min(holders[key]) == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(stay), hashlib.sha256(b"\n".join(stay)).hexdigest())
    return out


ORACLE = r"""
WITH line AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(s) + 1), lambda i: {'i': i, 'line': s[i]})) AS u
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), owner AS (
  SELECT key, min(doc_id) AS first FROM line WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT line.*, owner.first IS NOT NULL AND owner.first <> line.doc_id AS gone FROM line LEFT JOIN owner USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
