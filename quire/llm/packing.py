"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition cuts its documents into pieces and packs them best-fit decreasing. Bins whose residual
is at most ``slack`` are final. After best fit no two bins of a partition fit together, so at most
one of them is at most half full; only that one can still move, and the others can only host. Each
level of a tree merges the bins of ``FAN_IN`` groups as items of another best-fit round, and passes on
its movable bins with as many hosts of each residual as later rounds could use.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_small, materialize
from .tokens import MAX_WORDS, encode_each, forget_words, tokenizer_path

CAPACITY = 1024
END_ID = 2
FAN_IN = 16
HELD_IDS = 4_000_000
"""Ids that one local best-fit round holds in memory."""


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(items: Iterable[tuple[int, object]], capacity: int) -> list[list]:
    """Best-fit decreasing: (used, [(item, offset), ...]) for each bin.

    A bit mask of the residuals that open bins have finds the tightest bin in constant time.
    """
    open_bins: dict[int, list[int]] = defaultdict(list)
    mask, bins = 0, []
    for length, item in sorted(items, key=lambda x: -x[0]):
        fit = mask >> length
        if fit:
            residual = length + (fit & -fit).bit_length() - 1
            at = open_bins[residual].pop()
            if not open_bins[residual]:
                mask &= ~(1 << residual)
        else:
            residual, at = capacity, len(bins)
            bins.append([0, []])
        own = bins[at]
        own[1].append((item, own[0]))
        own[0] += length
        residual -= length
        if residual:
            open_bins[residual].append(at)
            mask |= 1 << residual
    return bins


def _pieces(docs: DataFrame, path: str, capacity: int, keep_ids: bool, max_words: int, keep_words: bool) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows, held, batch = TaskContext.get().partitionId() << 32, [], 0, None

        def flush(first: int) -> tuple[int, list[pa.RecordBatch]]:
            bins = best_fit(((r[3], i) for i, r in enumerate(rows)), capacity)
            which, place, used = (np.zeros(len(rows), np.int64) for _ in range(3))
            for k, (full, members) in enumerate(bins):
                for i, at in members:
                    which[i], place[i], used[i] = first + k, at, full
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(which), pa.array(place), pa.array(used.astype(np.int32))]
            whole = pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "bin", "place", "used"])
            return first + len(bins), [whole.slice(at, 20_000) for at in range(0, len(rows), 20_000)]

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode_each((x.as_py() for x in batch.column(1)), path, max_words=max_words), strict=True):
                raw += END_ID.to_bytes(4, "little")
                for k, (start, n) in enumerate(piece_bounds(len(raw) // 4, capacity)):
                    own = raw[4 * start : 4 * (start + n)]
                    rows.append((doc_id, k, start, n, zlib.crc32(own), own if keep_ids else None))
                    held += n if keep_ids else 8
            if held > HELD_IDS:
                base, out = flush(base)
                yield from out
                rows, held = [], 0
        if rows:
            yield from flush(base)[1]
        if not keep_words:
            rows = batch = None
            forget_words(path)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, bin long, place long, used int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, schema)


def _merge_level(bins: DataFrame, level: int, capacity: int) -> DataFrame:
    """One round: rows (grp, bin, used) become rows with the host each bin went to, and whether it goes on."""

    def of(key, pdf):
        import pandas as pd

        rows, kept = [], defaultdict(int)
        for used, members in best_fit(((int(n), b) for n, b in zip(pdf["used"], pdf["bin"], strict=True)), capacity):
            host = members[0][0]
            movable = used * 2 <= capacity
            goes_on = movable or used < capacity and kept[used] < FAN_IN
            kept[used] += not movable
            for member, at in members:
                rows.append((int(key[0]), int(member), int(host), int(at), int(used), bool(goes_on)))
        return pd.DataFrame(rows, columns=["grp", "bin", "host", "shift", "used", "on"])

    return materialize(bins.groupBy("grp").applyInPandas(of, "grp long, bin long, host long, shift long, used int, on boolean"), f"bins-{level}")


def _final_places(moves: list[DataFrame]) -> DataFrame:
    """(bin, host, shift) over all rounds: what a host's later move does to the bins that it took in before."""
    out = moves[0]
    for level, later in enumerate(moves[1:], 1):
        step = later.select(F.col("bin").alias("host"), F.col("host").alias("to"), F.col("shift").alias("by"))
        carried = out.join(step, "host", "left").select(
            "bin", F.coalesce("to", "host").alias("host"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")
        )
        out = materialize(carried.unionByName(later), f"places-{level}")
    return materialize(out, "places")


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    slack: int = 0,
    keep_ids: bool = True,
    max_words: int = MAX_WORDS,
    keep_words: bool = True,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset), one row for each piece.

    Null and empty texts are the end id alone. A document longer than ``capacity`` becomes pieces of
    exactly ``capacity`` ids but for a shorter first one. Equal rows are packed once each; a null doc_id
    stays null. Pieces of equal length and bins of equal residual are placed in any order. Offsets in a sequence are
    gapless from 0. An empty table gives an empty result; columns other than doc_id and text are not read.
    Without ``keep_words`` a worker's word table goes with the task: slower, but idle workers stay small.
    """
    pieces = materialize(_pieces(docs, path or tokenizer_path(), capacity, keep_ids, max_words, keep_words), "pieces")
    open_bins = pieces.where(F.col("place") == 0).where(F.col("used") < capacity - slack)
    # What leaves a partition: its movable bin, and as many hosts of each residual as one round can use.
    part = F.shiftright("bin", 32)
    ranked = (
        open_bins.select("bin", "used", part.alias("part"))
        .groupBy("part", "used")
        .agg(F.sort_array(F.collect_list("bin")).alias("bins"))
        .select("part", "used", F.explode(F.slice("bins", 1, FAN_IN)).alias("bin"))
    )
    level, moves = 0, []
    parts = ranked.agg(F.max("part")).first()[0]
    bins = ranked.select(F.floor(F.col("part") / FAN_IN).cast("long").alias("grp"), "bin", "used")
    groups = 0 if parts is None else parts // FAN_IN + 1
    while groups:
        out = _merge_level(bins, level, capacity)
        moves.append(out.where("host != bin or shift != 0").select("bin", "host", "shift"))
        if groups == 1:
            break
        bins = out.where("on and bin = host").select(F.floor(F.col("grp") / FAN_IN).cast("long").alias("grp"), "bin", "used")
        groups, level = -(-groups // FAN_IN), level + 1
    place, sequence = F.col("place"), F.col("bin")
    if moves:
        pieces = join_small(pieces, _final_places(moves), "bin", "left")
        place, sequence = F.col("place") + F.coalesce("shift", F.lit(0)), F.coalesce("host", "bin")
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", sequence.alias("sequence_id"), place.alias("offset"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; edge cases as of ``pack``."""
    return pack(documents(spark, sf_dir), keep_ids=False).drop("ids")
