"""SimHash near-duplicate detection with pigeonring candidate filtering.

A 64-bit fingerprint is cut into four 16-bit segments laid out on a ring. If two fingerprints differ in
at most three bits, some segment starts a chain whose running differences after 1, 2, 3 and 4 segments
stay within 0, 1, 2 and 3 bits (the proportional budgets l * 3 / 4). The first two segments of the chain are the join
key: the first is equal and the second differs in one bit at most. So every fingerprint goes to the key of its two segments
and to those with one set bit of the second segment cleared, where it meets all that differ in that bit; keys of 32
bits keep buckets small. The rest of the chain prunes candidates before the full Hamming distance is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_small, map_rows, materialize, sorted_groups, utf8
from .components import connected_components

SEED = 42
BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
MAX_DISTANCE = 3
BLOCK = 2048
"""Members of a key that one task compares with as many others; larger keys are cut into blocks."""


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle of the ASCII-lower-cased text; fewer words form one shingle."""
    words = (text or b"").lower().split()
    joined, n = b" ".join(words), len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if n <= size:
        return np.array([h(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - size + 1].tolist()
    return np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64, n - size + 1)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is 1 if it is set in over half of the shingle hashes; no word, zero."""
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 16384):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; a null text counts as empty."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, size) for t in utf8(batch.column(1))], pa.int64())], ["doc_id", "fp"])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, "doc_id long, fp long")


def ring_chain(x: np.ndarray, distance: int, segments: int = SEGMENTS) -> np.ndarray:
    """Has the difference x at most ``distance`` bits? Ring chains of segments are tried first, then all bits are counted.

    If the distance holds, some segment starts a chain that stays within l * distance / segments after each l segments.
    """
    width = BITS // segments
    counts = np.stack([np.bitwise_count((x >> np.uint64(width * i)) & np.uint64((1 << width) - 1)) for i in range(segments)]).astype(np.int64)
    alive = np.zeros(x.shape, bool)
    for start in range(segments):
        ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int64)
        for length in range(1, segments + 1):
            total = total + counts[(start + length - 1) % segments]
            ok &= total * segments <= length * distance
        alive |= ok
    alive[alive] = np.bitwise_count(x[alive]) <= distance
    return alive


def _chain_ok(x: np.ndarray, segment: np.ndarray | int) -> np.ndarray:
    """Does the ring chain that starts at ``segment`` (where the difference is 0) keep every budget?"""
    turn = np.uint64(WIDTH) * np.asarray(segment, np.uint64)
    r = np.where(turn == 0, x, (x >> turn) | (x << ((np.uint64(BITS) - turn) % np.uint64(BITS))))
    ok = np.ones(r.shape, bool)
    for length in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << (WIDTH * length)) - 1)
        ok &= np.bitwise_count(r & mask) <= length * MAX_DISTANCE // SEGMENTS
    return ok


def _settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _block_links(fp: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (least of the local component, member) inside one block; at most one link a member."""
    label, rest = np.arange(len(fp)), np.arange(len(fp))
    while rest.size:
        root, rest = rest[0], rest[1:]
        reached = [root]
        while reached and rest.size:
            hit = _chain_ok(fp[reached.pop()] ^ fp[rest], segment)
            label[rest[hit]] = root
            reached.extend(rest[hit].tolist())
            rest = rest[~hit]
    member = np.flatnonzero(label != np.arange(len(fp)))
    return label[member], member


def _links_in(part: np.ndarray, segment: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal part, one for each member that is not the least of its component."""
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    size = np.diff(np.r_[first, len(part)])
    out_a, out_b, a, b = [], [], [], []
    small = np.repeat(size <= 64, size)
    for d in range(1, int(min(size.max(), 64))):
        at = np.flatnonzero((part[:-d] == part[d:]) & small[d:])
        if not len(at):
            break
        at = at[_chain_ok(fp[at] ^ fp[at + d], segment[at])]
        a.append(at)
        b.append(at + d)
    if a and sum(map(len, a)):
        label = _settle(len(fp), np.concatenate(a), np.concatenate(b))
        member = np.flatnonzero(label != np.arange(len(fp)))
        out_a.append(label[member])
        out_b.append(member)
    for start, count in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        low, member = _block_links(fp[start : start + count], int(segment[start]))
        out_a.append(low + start)
        out_b.append(member + start)
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return fp[np.concatenate(out_a)].view(np.int64), fp[np.concatenate(out_b)].view(np.int64)


def chain_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fingerprints): for every ring start the two segments from there, as they are and with one set bit of the second cleared."""
    keys, values = [], []
    mask = np.uint64((1 << WIDTH) - 1)
    segment = [(fp >> np.uint64(WIDTH * i)) & mask for i in range(SEGMENTS)]
    for i in range(SEGMENTS):
        head, second = (np.uint64(i) << np.uint64(60)) | (segment[i] << np.uint64(WIDTH)), segment[(i + 1) % SEGMENTS]
        keys.append(head | second)
        values.append(fp)
        for bit in range(WIDTH):
            on = (second >> np.uint64(bit)) & np.uint64(1) == 1
            keys.append(head[on] | (second[on] ^ np.uint64(1 << bit)))
            values.append(fp[on])
    return np.concatenate(keys).view(np.int64), np.concatenate(values)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(u, v): a spanning set of the links between distinct fingerprints (column fp).

    A key over ``BLOCK`` members is cut by a hash into blocks, and every pair of its blocks is one group, so no
    task holds more than two blocks and every pair still meets. A group returns at most one link a member.
    """

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, fp = chain_keys(batch.column(0).to_numpy().view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], ["key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "part"):
            part, key, fp = (table[c].to_numpy() for c in ("part", "key", "fp"))
            u, v = _links_in(part, (key >> np.int64(60)).astype(np.uint64), fp.view(np.uint64))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    rows = map_rows(distinct.select("fp"), keyed, "key long, fp long")
    large = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), "large-keys")
    dealt = rows.withColumn("part", F.col("key"))
    if not large.isEmpty():
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        cut = join_small(rows, large, "key").select("key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        cut = cut.withColumn("part", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
        dealt = join_small(rows, large.select("key"), "key", "left_anti").withColumn("part", F.col("key")).unionByName(cut.drop("mine", "other"))
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(linked, "u long, v long")


def simhash_components(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints link at 3 or fewer bits, transitively.

    component_id is the smallest doc_id reachable. Null, empty and blank texts have fingerprint zero and
    link like any other; a document of fewer than ``size`` words is one shingle; equal rows each keep
    their row; a null doc_id stays null and is never a component id unless its whole component is null.
    An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    each = materialize(fingerprints(docs, size), "fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(distinct))
    member = materialize(roots.join(distinct.withColumnRenamed("fp", "node"), "node"), "members")
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    group = member.join(lowest, "root").select(F.col("node").alias("fp"), "component_id")
    named = materialize(distinct.join(group, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return each.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; edge cases as of ``simhash_components``."""
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
