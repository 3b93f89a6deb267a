"""SimHash near-dedup at a similarity: documents whose five-word shingle sets have a Jaccard similarity of at least 0.8.

Every set has a 64-bit SimHash. Sets that similar share one of their first shingles: in any one order of all shingles, one
of the first ``n - ceil(0.8 n) + 1`` of each (prefix filter), so these shingles are the blocking keys. Inside
a key, pairs are pruned by length bounds and by pigeonring: some ring chain of fingerprint segments must stay within its
proportional budgets of ``RADIUS`` bits, and so must the full Hamming distance. What is left meets by sketch, a bitmap of
about one bit a shingle that excludes no pair at 0.8, and what that leaves is compared shingle by shingle, so that whole sets
travel for few pairs but links. Sets just at 0.8 differ in 9 bits on average, sets of four and five shingles in 12; simulated, the radius
loses less than one link in 100,000 of the former and one in 5,000 of the latter. Everything else is exact over 64-bit shingle hashes.
The order puts shingles frequent in a sample last, so that stock passages seldom are keys.
Large groups are first joined through one member a key; only pairs not yet in one group are then compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, map_rows, materialize, release_memory, sorted_groups, utf8
from .components import connected_components
from .simhash import SEED, fingerprint_of, ring_chain, shingle_hashes

SIZE = 5
SAMPLE = 16
"""One row of so many is read for the frequencies, which decide the order alone, never the result."""
FREQUENT = 1 << 18
STARS = 4
STAR_SIZE = 32
"""Before pairs are formed, a set meets one member of each of its ``STARS`` most shared keys of over ``STAR_SIZE`` members."""
SALTS = 16
"""Tasks that the members of one such key are dealt to."""
BLOCK = 1024
"""Members of a key that one task compares with as many others; larger keys are cut into blocks."""
RADIUS = 24
"""Differing bits of two fingerprints whose sets are still compared."""


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SIZE))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the similarity of two sorted sets at least 0.8? Two empty sets are alike."""
    s = len(a) + len(b)
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * s


def sketch_of(h: np.ndarray) -> bytes:
    """The size of a set, then one bit for each residue of its hashes modulo a power of two: is their number odd?"""
    width = max(64, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return len(h).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def maybe_alike(a: bytes, b: bytes) -> bool:
    """Can sets of these sketches be alike? Never false of sets that are.

    A bit differs only if at least one shingle is in one set alone, and sets at 0.8 have at most a ninth of all theirs so.
    The longer sketch is folded to the shorter, which gives the sketch that the shorter modulus would have given.
    """
    x, y = sorted((np.frombuffer(raw, np.uint64) for raw in (a, b)), key=len)
    n, m = int(x[0]), int(y[0])
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    folded = np.bitwise_xor.reduce(y[1:].reshape(-1, len(x) - 1), axis=0)
    return 9 * int(np.bitwise_count(x[1:] ^ folded).sum()) <= n + m


def _in_groups(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(offset, shingle sets) of runs of rows that together hold few shingles."""
    start, held, n = 0, [], 0
    for t in utf8(batch.column(text)):
        held.append(shingle_set(t))
        n += len(held[-1])
        if n > 1 << 19:
            yield start, held
            start, held, n = start + len(held), [], 0
    if held:
        yield start, held


def _first_keys(rows: DataFrame) -> DataFrame:
    """(row, doc_id, sig, n, keys, fp, sketch) of every row."""
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text")

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, sets in _in_groups(batch, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    counts = map_rows(sample, read, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT)
    found = np.fromiter((r.h for r in counts.toLocalIterator()), np.int64).view(np.uint64)  # at most FREQUENT, the most frequent first
    order = np.argsort(found)
    shared = rows.sparkSession.sparkContext.broadcast((found[order], len(found) - order))

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        for start, sets in _in_groups(batch, 2):
            sig, keys = [], []
            for h in sets:
                first = len(h) - -(-4 * len(h) // 5) + 1 if len(h) else 0
                ordered = h
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    ordered = h[np.argsort(np.where(frequent[at] == h, rank[at], 0), kind="stable")]
                sig.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                keys.append(ordered[:first].view(np.int64))
            columns = [batch.column(i).slice(start, len(sets)) for i in (0, 1)]
            columns += [pa.array(np.array(sig, np.uint64).view(np.int64)), pa.array([len(h) for h in sets], pa.int32())]
            columns += [pa.array(keys, pa.list_(pa.int64())), pa.array([fingerprint_of(h) for h in sets], pa.int64())]
            columns.append(pa.array([sketch_of(h) for h in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "sig", "n", "keys", "fp", "sketch"])

    schema = "row long, doc_id long, sig long, n int, keys array<long>, fp long, sketch binary"
    return materialize(map_rows(rows.select("row", F.col("doc_id").cast("long"), "text"), of, schema), "shingles")


def _one_row(each: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sig, row): one row of every signature in the pairs."""
    sigs = pairs.select(F.col("u").alias("sig")).unionAll(pairs.select("v")).distinct()
    return materialize(each.select("sig", "row").join(sigs, "sig", "left_semi").groupBy("sig").agg(F.min("row").alias("row")), "set-rows")


def _sketches(each: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sig, value): the sketches of the signatures in the pairs."""
    found = join_small(each.select("row", "sketch"), _one_row(each, pairs), "row")
    return materialize(found.select("sig", F.col("sketch").alias("value")), "sketches")


def _sets(rows: DataFrame, each: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sig, value): the shingle sets of the signatures in the pairs, read again from one text of each."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, sets in _in_groups(batch, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), pa.array([h.tobytes() for h in sets], pa.binary())], ["sig", "value"])

    texts = join_small(rows.select("row", "text"), _one_row(each, pairs), "row")
    return materialize(map_rows(texts.select("sig", "text"), of, "sig long, value binary"), "sets")


def _shared_keys(each: DataFrame) -> DataFrame:
    """(key, sig, pos, size) for every key that two or more different sets have among their first."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "key"):
            key, sig, pos = (table[c].to_numpy() for c in ("key", "sig", "pos"))
            new = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])]  # copies of one set count once
            key, sig, pos = key[new], sig[new], pos[new]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[first, len(key)])
            size = np.repeat(count, count)
            on = size > 1
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(sig[on]), pa.array(pos[on]), pa.array(size[on])], ["key", "sig", "pos", "size"])
        release_memory()

    postings = each.select("sig", F.posexplode("keys").alias("pos", "key")).select("key", "sig", "pos")
    return materialize(postings.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(several, "key long, sig long, pos int, size long"), "keys")


def _star_links(rows: DataFrame, each: DataFrame, keys: DataFrame) -> DataFrame:
    """(u, v): sets like the first member of one of their most shared keys; linear in the members of a key."""
    most = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), "key"))), 1, STARS)
    picked = keys.where(F.col("size") > STAR_SIZE).groupBy("sig").agg(F.transform(most, lambda m: m["key"]).alias("picked"))
    picked = materialize(picked.select("sig", F.explode("picked").alias("key")), "picked")

    root = F.min_by("sig", F.xxhash64("key", "sig")).alias("u")
    roots = materialize(picked.groupBy("key").agg(root), "star-roots")
    pairs = materialize(join_small(picked, roots, "key").where("u <> sig").select("u", F.col("sig").alias("v")).distinct(), "star-pairs")
    return _verified(rows, each, pairs, SALTS)


def _kept(pairs: DataFrame, values: DataFrame, test: Callable[[bytes, bytes], bool], salts: int) -> DataFrame:
    """Those of the pairs (u, v) whose values pass the test. The pairs of one ``u`` go to up to ``salts`` tasks."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b"))
        return batch.select(["u", "v"]).filter(pa.array([test(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))

    right = pairs.join(
        values.select(F.col("sig").alias("v"), F.col("value").alias("b")), "v"
    ).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    left = values.join(pairs.select(F.col("u").alias("sig")).distinct(), "sig", "left_semi").select(
        F.col("sig").alias("u"), F.col("value").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    return map_rows(right.join(left, ["u", "salt"]).select("u", "v", "a", "b"), keep, "u long, v long")


def _verified(rows: DataFrame, each: DataFrame, pairs: DataFrame, salts: int = 1) -> DataFrame:
    """Those of the pairs (u, v) that are alike; sets are read only of those that their sketches leave."""

    def same(a: bytes, b: bytes) -> bool:
        return alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))

    likely = materialize(_kept(pairs, _sketches(each, pairs), maybe_alike, salts), "likely")
    return _kept(likely, _sets(rows, each, likely), same, salts)


def _pairs_in(sig: np.ndarray, n: np.ndarray, pos: np.ndarray, fp: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one key that no bound excludes and that are not in one group yet."""
    out_a, out_b = [], []
    for i in range(len(sig) - 1):
        j = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])
        s = n[j] + n[i]
        bound = np.minimum(n[i] - pos[i], n[j] - pos[j])  # of the shared shingles if this key is the first of them
        j = j[9 * bound >= 4 * s]
        if j.size:
            j = j[ring_chain(fp[j] ^ fp[i], RADIUS)]
            out_a.append(np.full(j.size, sig[i]))
            out_b.append(sig[j])
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


def _pair_links(rows: DataFrame, each: DataFrame, keys: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): all pairs of sets at 0.8 that are not in one group of ``roots``."""
    members = each.select("sig", "n", "fp").join(keys.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(
        F.first("n").alias("n"), F.first("fp").alias("fp")
    )
    grouped = members.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("root", "sig"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    joined = keys.join(grouped.select("sig", "n", "fp", "comp"), "sig").select("key", "sig", "pos", "n", "fp", "comp", mine.alias("mine"), other)
    dealt = joined.withColumn("part", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).drop("mine", "other", "key")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "part"):
            part = table["part"].to_numpy()
            sig, pos, n, comp = (table[c].to_numpy().astype(np.int64) for c in ("sig", "pos", "n", "comp"))
            fp = table["fp"].to_numpy().view(np.uint64)
            edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)].tolist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if (comp[lo:hi] == comp[lo]).all():
                    continue
                a, b = _pairs_in(sig[lo:hi], n[lo:hi], pos[lo:hi], fp[lo:hi], comp[lo:hi])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
        release_memory()

    pairs = materialize(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(candidates, "u long, v long").distinct(), "pairs")

    return _verified(rows, each, pairs)


def near_groups(rows: DataFrame) -> DataFrame:
    """(row, doc_id, sig, component) for each of ``rows`` (row, doc_id, text): groups linked at 0.8, transitively.

    Texts of no word are one group; a text of fewer than five words is one shingle.
    """
    each = _first_keys(rows)
    keys = _shared_keys(each)
    stars = materialize(_star_links(rows, each, keys), "stars")
    further = _pair_links(rows, each, keys, connected_components(stars))
    roots = connected_components(stars.unionByName(further)).withColumnRenamed("node", "sig")
    return each.select("row", "doc_id", "sig").join(roots, "sig", "left").select("row", "doc_id", "sig", F.coalesce("root", "sig").alias("component"))


def brute_force(texts: list[str | None]) -> list[int]:
    """The least index of each text's group, from word tuples."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + SIZE]) for i in range(max(len(w) - SIZE + 1, min(len(w), 1)))})
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label
