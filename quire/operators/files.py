"""File states, sharding and stratified selection.

Unless an operator says otherwise: file names are unique but in logs, of a log the row of the largest ``seq`` counts, null names join
nothing, and empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._durable import durable


def current_states(log: DataFrame, key: str = "file_name") -> DataFrame:
    """The last state of each file of an append-only log (file_name, state, seq)."""
    return log.groupBy(key).agg(F.max_by("state", "seq").alias("state"))


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n"))


def pending(files: DataFrame, states: DataFrame, done=("processed", "failed", "skipped"), key: str = "file_name", limit: int | None = None) -> DataFrame:
    """Files that are not done; a limit applies afterwards, in name order."""
    out = files.join(states.where(F.col("state").isin(*done)).select(key), key, "left_anti")
    return out if limit is None else out.orderBy(key).limit(limit)


def reset(states: DataFrame, names: DataFrame, key: str = "file_name") -> DataFrame:
    return states.join(names, key, "left_anti")


def upsert(store: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables with one row a key, the latest by ``order``."""
    both = store.unionByName(rows)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def shards(files: DataFrame, key: str, total: int) -> DataFrame:
    """Each file with its place in the sorted list and its shard, place modulo ``total``.

    Places come from a range partitioning: counts of ranges give each range its start, so no task sees all rows.
    """
    n = max(1, files.rdd.getNumPartitions())
    ranged = files.repartitionByRange(n, key).sortWithinPartitions(key)
    tagged = ranged.withColumn("__p", F.spark_partition_id())
    tagged = durable(tagged, "shards")
    starts, at = [], 0
    for row in sorted(tagged.groupBy("__p").count().collect()):  # one row a range
        starts.append((row["__p"], at))
        at += row["count"]
    table = F.broadcast(files.sparkSession.createDataFrame(starts, "__p int, __start long"))
    w = Window.partitionBy("__p").orderBy(key)
    placed = tagged.withColumn("__n", F.row_number().over(w)).join(table, "__p")
    return placed.withColumn("place", F.col("__start") + F.col("__n") - 1).withColumn("shard", F.pmod("place", F.lit(total))).drop("__p", "__n", "__start")


def diverse_sample(files: DataFrame, strata: list[str], key: str, target: int = 100, least: int = 2, reserve: float = 1.5, seed: int = 42) -> DataFrame:
    """(key, strata, role): ``least`` files of each stratum, filled up to ``target``, then a reserve.

    The order in all draws is a hash of key and seed, so a draw does not depend on partitioning. Each task keeps only
    the first rows of a stratum, and only the first rows by hash that the fill could need are ordered. Keys are unique;
    a null stratum is one of its own.
    """
    h = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256)
    hashed = files.select(key, *strata, h.alias("h"))
    first = F.row_number().over(Window.partitionBy(*strata).orderBy("h"))
    sure = durable(hashed.withColumn("in_stratum", first).where(F.col("in_stratum") <= least).drop("in_stratum").withColumn("role", F.lit("primary")), "sure")
    taken = sure.count()
    fill, extra = max(0, target - taken), int(target * reserve) - target
    rest = hashed.orderBy("h").limit(fill + extra + taken).join(sure.select("h"), "h", "left_anti").orderBy("h").limit(fill + extra)
    drawn = rest.withColumn("n", F.row_number().over(Window.orderBy("h")))  # as few rows as are drawn
    drawn = drawn.withColumn("role", F.when(F.col("n") <= fill, "primary").otherwise("reserve")).drop("n")
    return sure.unionByName(drawn).select(key, *strata, "role")


def unselected(files: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Files that a selection left out."""
    return files.join(selected.select(key), key, "left_anti")


def lookup(rows: DataFrame, order: list[str], **keys) -> DataFrame:
    """The first row, by ``order``, whose columns have these values, or none."""
    for name, value in keys.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows.orderBy(*order).limit(1)


def fixed_mix(files: DataFrame, shares: dict[str, float], stratum: str, key: str, target: int = 100, seed: int = 42) -> DataFrame:
    """(key, stratum): ``target`` files in fixed shares of the named strata, each share drawn by a hash of key and seed."""
    quota = F.lit(None).cast("int")
    for name, share in shares.items():
        quota = F.when(F.col(stratum) == name, F.lit(round(target * share))).otherwise(quota)
    h = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256)
    ranked = files.where(F.col(stratum).isin(*shares)).select(key, stratum, F.row_number().over(Window.partitionBy(stratum).orderBy(h)).alias("n"))
    most = max((round(target * s) for s in shares.values()), default=0)
    return ranked.where(F.col("n") <= most).where(F.col("n") <= quota).select(key, stratum)


def type_counts(files: DataFrame) -> DataFrame:
    """(doc_type, n) from (path)."""
    from ..functions import text as T

    return files.groupBy(T.path_type("path").alias("doc_type")).agg(F.count("*").alias("n"))


def in_state(states: DataFrame, *names: str) -> DataFrame:
    """Files in one of these states, with all that is known of them."""
    return states.where(F.col("state").isin(*names))


def latest_events(log: DataFrame, key: str = "file_name") -> DataFrame:
    """The last event of each file of a log (file_name, state, seq, stage, error, reason)."""
    last = F.max_by(F.struct("state", "stage", "error", "reason"), "seq").alias("e")
    return log.groupBy(key).agg(last).select(key, "e.*")


def by_type(files: DataFrame) -> DataFrame:
    """(batch, doc_type, files) of known batches from (path)."""
    from ..functions import text as T

    typed = files.select("path", T.path_batch("path").alias("batch"), T.path_type("path").alias("doc_type"))
    return typed.where("batch <> 'unknown'").groupBy("batch", "doc_type").agg(F.array_sort(F.collect_list("path")).alias("files"))


def replace_failures(primary: DataFrame, reserve: DataFrame, states: DataFrame, target: int, key: str = "file_name") -> DataFrame:
    """The next reserve files to run so that ``target`` files can succeed: as many as were skipped or failed."""
    ok = states.where("state = 'processed'").count()
    tried = states.select(key)
    open_ = primary.join(tried, key, "left_anti").count()
    return reserve.join(tried, key, "left_anti").orderBy(key).limit(max(0, target - ok - open_))


def run_with_replacement(primary: DataFrame, reserve: DataFrame, run: Callable[[DataFrame], DataFrame], target: int, key: str = "file_name") -> DataFrame:
    """(key, state) of all files that were run until ``target`` of them succeeded or the reserve was used up.

    ``run`` takes files and returns (key, state) for each, state being processed, failed or skipped. Each round runs as many
    reserve files as are still wanting, so rounds are few.
    """
    done = durable(run(primary).select(key, "state"), "run")
    while not (batch := durable(replace_failures(primary, reserve, done, target, key), "next")).isEmpty():
        done = durable(done.unionByName(run(batch).select(key, "state")), "run")
    return done
