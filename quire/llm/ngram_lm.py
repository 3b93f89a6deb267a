"""Stupid-backoff scores of every document against n-gram counts of the whole corpus.

Documents fall into batches by a hash. A batch explodes its n-grams into (hash, count), one entry for each
distinct n-gram however frequent it is there. Sorted by hash and cut by hash range, these entries travel as arrays to the
partition of their range, which explodes them again: its rows are the count table of all orders, and a sum by hash joins
every n-gram's corpus count to the entries that asked. Where other batches hold an n-gram too, its place and count
return to the batch, which joins them to its exploded n-grams and sums them per document. The empty n-gram counts the words
of the corpus. Entries, and so shuffles, grow in proportion to the text; an n-gram has one entry a batch at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_rows
from .decontaminate import words_of

ALPHA = 0.4
ORDER = 2
BATCH_CHARS = 8_000_000
"""Of a batch at most, on average; small tables make ``MIN_BATCHES`` smaller ones, so that all tasks have work."""
MIN_BATCHES = 64
MIN_BATCH_CHARS = 1_000_000
PART_CHARS = 1_000_000
"""Text whose n-grams one hash range holds; a task has several ranges."""
WORDS = np.uint64(0)
"""Hash of the empty n-gram, which occurs once at every word."""


class Batch:
    """The n-grams of some documents: per order the sorted distinct hashes, their counts and each word's n-gram."""

    def __init__(self, texts: list[bytes | None], order: int) -> None:
        vocabulary: dict[bytes, int] = {}
        numbers, sizes = [], []
        for text in texts:
            words = words_of(text)
            for w in set(words).difference(vocabulary):
                vocabulary[w] = len(vocabulary)
            numbers.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        h = xxhash.xxh3_64_intdigest
        hashes = np.fromiter(map(h, vocabulary), np.uint64, len(vocabulary))
        ids = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
        del numbers
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        self.place = (np.arange(len(ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)).astype(np.int32)
        self.distinct: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.inverse: list[np.ndarray] = []  # for words from place n-1 of their document
        self.where: list[np.ndarray] = []
        word = hashes[ids] if len(ids) else np.empty(0, np.uint64)
        gram = word
        for n in range(1, order + 1):
            if n > 1:  # the n-gram that ends at each word, from the one that ended at the word before
                gram = np.r_[np.zeros(1, np.uint64), gram[:-1]] if len(gram) else gram
                gram = (gram * np.uint64(0x9E3779B97F4A7C15) ^ word) * np.uint64(0xC2B2AE3D27D4EB4F)
                gram ^= gram >> np.uint64(29)
            at = np.flatnonzero(self.place >= n - 1)
            found, inverse, counts = np.unique(gram[at], return_inverse=True, return_counts=True)
            self.where.append(at.astype(np.int32))
            self.distinct.append(found)
            self.inverse.append(inverse.astype(np.int32))
            self.counts.append(counts)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the empty and all distinct n-grams, their counts, and where each stands in order of length."""
        grams = np.concatenate([np.array([WORDS]), *self.distinct])
        order = np.argsort(grams, kind="stable")
        return grams[order], np.concatenate([np.array([len(self.doc)]), *self.counts])[order], order

    def own_counts(self, n: int) -> np.ndarray:
        """For each word with an n-gram: how often its document holds that n-gram."""
        key = self.doc[self.where[n - 1]] * np.int64(max(1, len(self.distinct[n - 1]))) + self.inverse[n - 1]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        return counts[inverse]

    def scores(self, totals: list[np.ndarray], words: int) -> np.ndarray:
        """Sum of natural log scores of each document; ``totals`` align with ``distinct``. A document's own counts are left out."""
        n_words = len(self.doc)
        rest = np.maximum(words - self.sizes[self.doc], 1).astype(np.float64)
        outside = []
        for n in range(1, len(totals) + 1):
            full = np.zeros(n_words)
            full[self.where[n - 1]] = totals[n - 1][self.inverse[n - 1]] - self.own_counts(n)
            outside.append(full)
        value = np.maximum(outside[0], 0.5) / rest
        for n in range(2, len(totals) + 1):
            context = np.r_[0.0, outside[n - 2][:-1]] if n_words else outside[n - 2]
            hit = (self.place >= n - 1) & (outside[n - 1] > 0) & (context > 0)
            value = np.where(hit, outside[n - 1] / np.maximum(context, 1), np.where(self.place >= n - 1, ALPHA * value, value))
        return np.bincount(self.doc, np.log(value), len(self.sizes)) if n_words else np.zeros(len(self.sizes))


def backoff_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for every row.

    S(w | context) = c(context w) / c(context) where both were seen in other documents, else 0.4 times
    the score of the shorter context, down to c(w) / N; an unseen word counts as half an occurrence. Counts cover
    the whole corpus less the document itself. N-grams are told apart by a 64-bit hash. Null or empty texts have
    no words and score 0 (mean null). Rows that repeat count and score each; a null doc_id stays null; an empty table
    gives an empty result. Columns other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    batches = max(1, math.ceil(chars / max(MIN_BATCH_CHARS, min(BATCH_CHARS, chars / MIN_BATCHES))))
    part_bits = max(1, math.ceil(math.log2(max(2, chars / PART_CHARS))))
    numbered = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"), "doc_id", "text")
    packed = map_rows(numbered, _pack, "batch int, blob binary")

    def ask(table: pa.Table) -> pa.Table:
        batch = Batch(_unpack(table)["text"].cast(pa.binary()).to_pylist(), order)
        grams, own, _ = batch.entries()
        ends = np.searchsorted(grams >> np.uint64(64 - part_bits), np.arange((1 << part_bits) + 1))
        parts = np.flatnonzero(np.diff(ends))
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.r_[ends[parts], len(grams)], pa.int32()), pa.array(x, kind))
        number = np.full(len(parts), table["batch"][0].as_py(), np.int32)
        return pa.table({"batch": number, "part": parts.astype(np.int32), "grams": lists(grams.view(np.int64), pa.int64()), "own": lists(own, pa.int64())})

    asked = packed.groupBy("batch").applyInArrow(ask, "batch int, part int, grams array<long>, own array<long>")
    rows_of_part = asked.repartition("part").select(
        "batch", "part", F.posexplode(F.arrays_zip("grams", "own")).alias("place", "e")
    ).select("batch", "part", "place", "e.grams", "e.own")
    # A window: a sum joined back to the rows would deal them out twice. They stay in the partition of their range.
    counted = rows_of_part.withColumn("total", F.sum("own").over(Window.partitionBy("grams", "part")))
    # Places and counts of one batch and range travel together.
    answer = F.array_sort(F.collect_list(F.struct("place", "total")))
    told = counted.where("total > own").groupBy("batch", "part").agg(answer.alias("a")).select(
        "batch", "part", F.col("a.place").alias("places"), F.col("a.total").alias("totals")
    )

    def score(text: pa.Table, told: pa.Table) -> pa.Table:
        text = _unpack(text)
        batch = Batch(text["text"].cast(pa.binary()).to_pylist(), order)
        grams, own, order_of = batch.entries()
        starts = np.searchsorted(grams >> np.uint64(64 - part_bits), np.arange(1 << part_bits))
        sums = own.copy()
        for chunk in told.to_batches():
            part, places, totals = (chunk.column(chunk.schema.get_field_index(c)) for c in ("part", "places", "totals"))
            sizes = np.diff(places.offsets.to_numpy())
            sums[np.repeat(starts[part.to_numpy()], sizes) + places.flatten().to_numpy()] = totals.flatten().to_numpy()
        by_order = np.empty_like(sums)
        by_order[order_of] = sums
        cuts = np.cumsum([1, *map(len, batch.distinct)])
        total = batch.scores(np.split(by_order[1:], cuts[1:-1] - 1), int(by_order[0]))
        mean = [s / n if n else None for s, n in zip(total.tolist(), batch.sizes.tolist(), strict=True)]
        return pa.table({"doc_id": text["doc_id"], "n_words": batch.sizes, "log_score": total, "mean_log_score": pa.array(mean, pa.float64())})

    return packed.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double")


def _pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (batch, doc_id, text) as one compressed blob for each batch."""
    number = batch.column(0).to_numpy()
    order = np.argsort(number, kind="stable")
    found, first = np.unique(number[order], return_index=True)
    for b, at in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        own, sink = batch.select(["doc_id", "text"]).take(pa.array(at)), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(own)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "blob"])


def _unpack(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in table["blob"]])


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores rounded to six digits, so that the order of summation does not show."""
    found = backoff_scores(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT doc_id, len(w) AS size, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d
), p AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t
), n AS (SELECT count(*) AS n FROM t
), g1 AS (SELECT w, count(*) AS c FROM t GROUP BY w), o1 AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY doc_id, w
), g2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w), o2 AS (SELECT doc_id, v, w, count(*) AS c FROM p
  WHERE v IS NOT NULL GROUP BY doc_id, v, w
), c AS (
  SELECT p.doc_id, p.v, n.n - p.size AS rest, g1.c - o1.c AS cw, gv.c - ov.c AS cv, g2.c - o2.c AS cvw
  FROM p JOIN n ON true JOIN g1 ON g1.w = p.w JOIN o1 ON o1.doc_id = p.doc_id AND o1.w = p.w
  LEFT JOIN g1 gv ON gv.w = p.v LEFT JOIN o1 ov ON ov.doc_id = p.doc_id AND ov.w = p.v
  LEFT JOIN g2 ON g2.v = p.v AND g2.w = p.w LEFT JOIN o2 ON o2.doc_id = p.doc_id AND o2.v = p.v AND o2.w = p.w
), s AS (
  SELECT doc_id, count(*) AS n_words,
         sum(ln(CASE WHEN cvw > 0 THEN cvw / cv ELSE (CASE WHEN v IS NULL THEN 1.0 ELSE 0.4 END) * greatest(cw, 0.5) / greatest(rest,
  1) END)) AS s FROM c GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(s, 0.0), 6) AS log_score, round(s / n_words, 6) AS mean_log_score FROM d LEFT
  JOIN s USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]], order: int = ORDER) -> dict[int, tuple[int, float]]:
    """The same scores by dictionaries of word tuples."""
    from collections import Counter

    texts = [(i, words_of((t or "").encode())) for i, t in rows]
    grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = [sum((grams(w, n) for _, w in texts), Counter()) for n in range(1, order + 1)]
    words, out = sum(len(w) for _, w in texts), {}
    for i, w in texts:
        own = [grams(w, n) for n in range(1, order + 1)]
        count = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        s = 0.0
        for k in range(len(w)):
            value = max(count((w[k],)), 0.5) / max(words - len(w), 1)
            for n in range(2, min(order, k + 1) + 1):
                g = tuple(w[k - n + 1 : k + 1])
                hit = count(g) > 0 and count(g[:-1]) > 0
                value = count(g) / count(g[:-1]) if hit else ALPHA * value
            s += math.log(value)
        out[i] = (len(w), s)
    return out
