"""Evaluation reports over annotations and benchmark results.

Unless an operator says otherwise: null values take no part in means, a ratio of nothing is 0, rows that repeat count each, and
an empty table gives a report of zeros, or no rows where the result is by group. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def page_scores(judged: DataFrame, missing: DataFrame) -> DataFrame:
    """Per page of judgments (page, judgment, hallucinated): precision, recall, f1, hallucination.

    Correct and partial count for precision, correct alone for recall; ``missing`` has (page, n_missing).
    """
    own = judged.groupBy("page").agg(
        F.count("*").alias("n"), F.count_if(F.col("judgment") == "correct").alias("correct"),
        F.count_if(F.col("judgment") == "partial").alias("partial"), F.count_if(F.col("hallucinated")).alias("hallucinated")
    )
    both = own.join(missing, "page", "left").fillna(0, ["n_missing"])
    precision = T.ratio(F.col("correct") + F.col("partial"), F.col("n"))
    recall = T.ratio(F.col("correct"), F.col("correct") + F.col("n_missing"))
    scored = both.select("page", "n", precision.alias("precision"), recall.alias("recall"), T.ratio(F.col("hallucinated"), F.col("n")).alias("hallucination"))
    return scored.withColumn("f1", T.f1(F.col("precision"), F.col("recall")))


def macro_report(scores: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c)
    return scores.agg(F.count("*").alias("pages"), *[mean(c) for c in ("precision", "recall", "f1", "hallucination")])


def schema_validity(types: DataFrame, valid: list[str]) -> DataFrame:
    """Share of types among ``valid``; 1 if there are none."""
    return types.agg(T.ratio(F.count_if(F.col("type").isin(*valid)), F.count("*"), 1.0).alias("validity"))


def method_votes(pages: DataFrame) -> DataFrame:
    """Votes for each selected_method and the mean error rates of the pages where that method succeeded."""
    ok = lambda flag, c: F.round(F.avg(F.when(F.col(flag), F.col(c))), 6).alias(f"mean_{c}")
    return pages.agg(
        F.count("*").alias("pages"), F.count_if(F.col("selected_method") == "native").alias("native_votes"),
        F.count_if(F.col("selected_method") == "ocr").alias("ocr_votes"), ok("native_success", "cer_native"), ok("ocr_success", "cer_ocr")
    )


def default_method(native_ok, ocr_ok):
    return F.when(~native_ok & ocr_ok, "ocr").otherwise("native")


def compare_methods(results: DataFrame) -> DataFrame:
    """Per method of results (method, total_pages, processing_time, memory_peak, n_errors and any of cer, wer, similarity) without errors.

    Speed is all pages over all time; null rates do not count.
    """
    good = results.where("n_errors = 0")
    speed = T.ratio(F.sum("total_pages"), F.sum("processing_time"))
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("cer", "wer", "similarity") if c in results.columns]
    return good.groupBy("method").agg(
        F.count("*").alias("n"), F.round(speed, 6).alias("pages_per_second"), F.round(F.avg("memory_peak"), 6).alias("mean_memory"), *means
    )


def best_performers(compared: DataFrame) -> DataFrame:
    """Fastest, leanest and most accurate method; ties to the later name."""
    return compared.agg(
        F.max_by("method", F.struct("pages_per_second", "method")).alias("fastest"),
        F.min_by("method", F.struct("mean_memory", "method")).alias("leanest"),
        F.min_by("method", F.struct("mean_cer", "method")).alias("most_accurate")
    )


def metric_summary(long: DataFrame) -> DataFrame:
    """(metric, n, mean, median, std) of (metric, value); the deviation is that of a sample."""
    return long.groupBy("metric").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"),
        F.round(F.stddev_samp("value"), 6).alias("std")
    )


def shares(counts: DataFrame, by: str = "n") -> DataFrame:
    total = counts.agg(F.sum(by)).first()[0] or 0
    return counts.withColumn("share", F.round(T.ratio(F.col(by), F.lit(float(total))), 6))
