"""Exact top-k inner products with a bit-sliced index.

Every component of a block of rows becomes unsigned bit slices: bitmaps with one bit a row. They are built and
written once, as the index. A query adds the slices of its components' multiples with carry-save bitmap adders, which
gives the slices of all scores at once, however wide the components are. Rows are then selected from the most
significant slice downward; as soon as few rows are undecided, those boundary rows are scored exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 64
K = 20
QUERY_STEP = 20
BLOCK_ROWS = 32768
BLOCK_QUERIES = 1024
LIMIT = 1 << 62
"""Quantised components from here on are an error, as are returned scores that do not fit a long."""
MULTIPLES_BYTES = 256 << 20
"""Of the multiples of a block's slices that are kept between queries."""

Slices = list[np.ndarray]


def bitmap(flags: np.ndarray) -> np.ndarray:
    packed = np.packbits(flags, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.uint64)


def rows_of(bits: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), count=n, bitorder="little"))


def sum_slices(columns: list[list[np.ndarray]]) -> Slices:
    """Slices of the sum of all planes; ``columns[w]`` are the planes of weight 2^w. Three planes of a weight become one and a carry."""
    out, w = [], 0
    while w < len(columns):
        planes = columns[w]
        if len(planes) > 1 and w + 1 == len(columns):
            columns.append([])
        while len(planes) > 2:
            a, b, c = planes.pop(), planes.pop(), planes.pop()
            t = a ^ b
            planes.append(t ^ c)
            columns[w + 1].append((a & b) | (t & c))
        if len(planes) == 2:
            a, b = planes
            columns[w + 1].append(a & b)
            planes = [a ^ b]
        out.append(planes[0] if planes else None)
        w += 1
    return out


def select_top(slices: Slices, allowed: np.ndarray, k: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of rows surely among the top k, bitmap of undecided rows), from the top slice down."""
    sure, open_ = np.zeros_like(allowed), allowed
    n_sure, n_open = 0, int(np.bitwise_count(allowed).sum())
    for plane in reversed(slices):
        if n_sure + n_open <= max(k, enough):
            break
        if plane is None:
            continue
        high = open_ & plane
        n = int(np.bitwise_count(high).sum())
        if n_sure + n > k:
            open_, n_open = high, n
        else:
            sure, n_sure = sure | high, n_sure + n
            open_, n_open = open_ & ~plane, n_open - n
            if n_sure == k:
                return sure, np.zeros_like(sure)
    return sure, open_


class Block:
    """Bit-sliced index of some rows in ascending vec_id order; ``planes`` are the slices if they were stored."""

    def __init__(self, vec_ids: np.ndarray, matrix: np.ndarray, planes: bytes | None = None) -> None:
        if planes is None:
            order = np.argsort(vec_ids, kind="stable")
            vec_ids, matrix = vec_ids[order], matrix[order]
        self.ids, self.matrix = vec_ids, matrix.astype(np.int64)
        low, high = (f(self.matrix, axis=0).tolist() for f in (np.min, np.max))
        self.low, self.most = low, [max(abs(a), abs(b)) for a, b in zip(low, high, strict=True)]
        bits = [(h - a).bit_length() for a, h in zip(low, high, strict=True)]
        self.valid = bitmap(np.ones(len(self.ids), bool))
        if planes is None:
            self.slices = [[bitmap(((self.matrix[:, d] - low[d]) >> b & 1).astype(bool)) for b in range(n)] for d, n in enumerate(bits)]
        else:
            flat = iter(np.frombuffer(planes, np.uint64).reshape(sum(bits), -1) if sum(bits) else ())
            self.slices = [[next(flat) for _ in range(n)] for n in bits]
        self.multiples: dict[tuple[int, int], Slices] = {}
        self.kept = 0

    def planes(self) -> bytes:
        return b"".join(s.tobytes() for own in self.slices for s in own)

    def multiple(self, d: int, m: int) -> Slices:
        """Slices of |m| * (x - low), or of |m| * (2^bits - 1 - (x - low)) for a negative m."""
        found = self.multiples.get((d, m))
        if found is None:
            base = self.slices[d] if m > 0 else [~s for s in self.slices[d]]
            columns: list[list[np.ndarray]] = [[] for _ in range(abs(m).bit_length() + len(base))]
            for j in range(abs(m).bit_length()):
                if abs(m) >> j & 1:
                    for b, plane in enumerate(base):
                        columns[j + b].append(plane)
            found = sum_slices(columns)
            if self.kept < MULTIPLES_BYTES:
                self.multiples[d, m] = found
                self.kept += sum(p.nbytes for p in found if p is not None)
        return found

    def top(self, query_id: int | None, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows other than the query's own, ties to the smaller vec_id."""
        columns: list[list[np.ndarray]] = []
        for d, m in enumerate(vector.tolist()):
            if m:
                for w, plane in enumerate(self.multiple(d, m)):
                    while len(columns) <= w:
                        columns.append([])
                    if plane is not None:
                        columns[w].append(plane)
        allowed = self.valid
        if query_id is not None:
            a, b = np.searchsorted(self.ids, [query_id, query_id + 1])
            if b > a:
                own = np.zeros(len(self.ids), bool)
                own[a:b] = True
                allowed = allowed & ~bitmap(own)
        sure, open_ = select_top(sum_slices(columns), allowed, k, 4 * k)
        rows = rows_of(sure, len(self.ids))
        boundary = rows_of(open_, len(self.ids))
        rows = np.concatenate([rows, boundary])
        if sum(abs(m) * n for m, n in zip(vector.tolist(), self.most, strict=True)) < 1 << 63:
            scores = self.matrix[rows] @ vector
            best = np.lexsort((self.ids[rows], -scores))[:k]
            return rows[best], scores[best]
        exact = [sum(a * b for a, b in zip(x, vector.tolist(), strict=True)) for x in self.matrix[rows].tolist()]
        best = sorted(range(len(rows)), key=lambda r: (-exact[r], self.ids[rows[r]]))[:k]
        return rows[best], np.array([exact[r] for r in best], np.int64)  # raises OverflowError beyond a long


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) with q = floor(scale * x) as longs; null ids and vectors that are null or not wholly finite are left out.

    An empty vector stays, with the score 0 to every query. A component of ``LIMIT`` or more after scaling is an error.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def whole(v):
        scaled = F.floor(v.cast("double") * scale)
        return F.when(F.abs(v.cast("double") * scale) < float(LIMIT), scaled).otherwise(F.raise_error(F.lit("component too large")).cast("long"))

    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("q")
    )


def _matrix(values: list[list[int]]) -> tuple[int, np.ndarray]:
    """(bytes of a component, matrix): shorter vectors are padded with zeros."""
    dims = max(map(len, values))
    top = max((abs(x) for v in values for x in v), default=0)
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    matrix = np.zeros((len(values), dims), f"<i{width}")
    for r, v in enumerate(values):
        matrix[r, : len(v)] = v
    return width, matrix


def _blocks(rows: DataFrame, number: int, slices: bool) -> DataFrame:
    """Rows dealt into ``number`` blocks, numbered from 0, with their slices or without."""

    def of(batches):
        from pyspark import TaskContext

        ids, values = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            values += batch.column(1).to_pylist()
        if ids:
            width, matrix = _matrix(values)
            numbers, planes = np.array(ids, "<i8"), None
            if slices:
                block = Block(numbers, matrix)
                numbers, matrix, planes = block.ids, block.matrix.astype(matrix.dtype), block.planes()
            columns = [[TaskContext.get().partitionId()], [matrix.shape[1]], [width], [numbers.tobytes()], [matrix.tobytes()], [planes]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "dims", "width", "ids", "matrix", "planes"]
            )

    return rows.select("vec_id", "q").repartition(number).mapInArrow(of, "block long, dims int, width int, ids binary, matrix binary, planes binary")


def build_index(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The written index, one row for each block of about ``BLOCK_ROWS`` of the rows (vec_id, q), and the number of blocks."""
    number = math.ceil(vectors.count() / BLOCK_ROWS)
    return materialize(_blocks(vectors, max(1, number), True), "bit-slices"), number


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every query.

    Both frames have (vec_id, q) as of ``quantise``; further columns are not read. Rows with the query's vec_id are
    its own and take no part for it. Ties go to the smaller vec_id; rows that repeat a candidate are candidates each; a
    query row that repeats exactly asks once, a query id with several vectors gets one list for each. Vectors of
    different lengths count as padded with zeros. No queries or no candidates, no rows. Blocks of candidates meet blocks
    of queries in one task each, and each returns k rows a query, so no task or key depends on how alike the vectors are.
    """
    spark = vectors.sparkSession
    asked = queries.select("vec_id", "q").distinct()
    index, n_blocks = build_index(vectors)
    n_asks = math.ceil(asked.count() / BLOCK_QUERIES)
    if not n_blocks or not n_asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asks = materialize(_blocks(asked, n_asks, False), "query-blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.withColumn("ask", every(n_asks))
    right = asks.select(
        F.col("block").alias("ask"), *[F.col(c).alias(f"q_{c}") for c in ("dims", "width", "ids", "matrix")]
    ).withColumn("block", every(n_blocks))

    def meet(cand: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for c in cand.to_pylist():
            block = Block(
                np.frombuffer(c["ids"], "<i8"),
                np.frombuffer(c["matrix"], f"<i{c['width']}").reshape(-1, c["dims"]) if c["dims"] else np.zeros((len(c["ids"]) // 8, 0), np.int64),
                c["planes"]
            )
            for a in ask.to_pylist():
                q_ids = np.frombuffer(a["q_ids"], "<i8").tolist()
                q = np.frombuffer(a["q_matrix"], f"<i{a['q_width']}").reshape(len(q_ids), a["q_dims"]).astype(np.int64)
                fit = np.zeros((len(q), c["dims"]), np.int64)
                fit[:, : min(c["dims"], a["q_dims"])] = q[:, : c["dims"]]
                for n, (i, vector) in enumerate(zip(q_ids, fit, strict=True)):
                    rows, scores = block.top(i, vector, k)
                    out.append((a["ask"] * 2 * BLOCK_QUERIES + n, i, block.ids[rows], scores))
        sizes = [len(s) for *_, s in out]
        empty = [np.empty(0, np.int64)]
        number, i, v, s = zip(*out, strict=True) if out else ((), (), empty, empty)
        return pa.table(
            {
                "number": np.repeat(np.array(number, np.int64), sizes), "query_id": np.repeat(np.array(i, np.int64), sizes),
                "vec_id": np.concatenate(v), "score": np.concatenate(s)
            }
        )

    found = left.groupBy("block", "ask").cogroup(right.groupBy("block", "ask")).applyInArrow(meet, "number long, query_id long, vec_id long, score long")
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every twentieth one; edge cases as of ``quantise`` and ``top_k``."""
    rows = materialize(quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")), "quantised")
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
