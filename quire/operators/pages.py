"""Page-level projections and joins: names, method comparison, evaluation of predictions.

Null texts are treated as empty unless stated; rows that repeat are treated each; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import text as T


def tracker(stem: Column | str) -> Column:
    """The part of a stem before its first hyphen, null if there is none."""
    parts = F.split(T.col(stem), "-")
    return F.when(F.size(parts) > 1, parts[0])


def bug_id(stem: Column | str) -> Column:
    """The part between the first and the second hyphen of a stem, null if it has none."""
    parts = F.split(T.col(stem), "-")
    return F.when(F.size(parts) > 1, parts[1])


def page_document_id(stem: Column | str, place: Column | str) -> Column:
    """The document id of a page by its place (from 1) in the file, not by its number."""
    return F.concat(T.col(stem), F.lit("_page_"), T.col(place).cast("string"))


def image_name(stem: Column | str, page: Column | str) -> Column:
    return F.format_string("%s_page_%04d.png", T.col(stem), T.col(page).cast("int"))


def encoded_image(content: Column | str) -> Column:
    """Bytes as base64 in one line."""
    return F.replace(F.base64(T.col(content)), F.lit("\r\n"), F.lit(""))


def native_coverage(overall: Column | str, coverage: Column | str) -> Column:
    """The coverage of a document under either of its names; null counts as 0."""
    return F.coalesce(T.col(overall), T.col(coverage), F.lit(0.0))


def document_coverage(pages: DataFrame) -> DataFrame:
    """(document_id, overall_coverage, total_pages): the mean coverage of the pages, to four places."""
    return pages.groupBy("document_id").agg(F.round(F.coalesce(F.avg("coverage"), F.lit(0.0)), 4).alias("overall_coverage"), F.count("*").alias("total_pages"))


def export_text(pages: DataFrame, limit: int = 10_000, suffix: str = "\n\n[Text truncated...]") -> DataFrame:
    """(document_id, text): recognised text of each page, or else the native one, in order and joined by blank lines, cut at ``limit``."""
    own = F.struct("page_number", T.pick_for_export("native", "ocr").alias("text"))
    joined = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(own)).alias("p")).select(
        "document_id", F.array_join(F.filter(F.transform("p", lambda p: p["text"]), lambda t: t != ""), "\n\n").alias("text")
    )
    return joined.withColumn("text", F.when(F.length("text") > limit, F.concat(F.left("text", F.lit(limit)), F.lit(suffix))).otherwise(F.col("text")))


def whole_recognition(pages: DataFrame) -> DataFrame:
    """(document_id, text, error): page texts in order joined by blank lines; a document of no page image is an error."""
    own = F.when(F.col("text").isNotNull(), F.struct("page_number", "text"))
    found = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(own)).alias("p"))
    return found.select(
        "document_id", F.array_join(F.transform("p", lambda p: p["text"]), "\n\n").alias("text"),
        F.when(F.size("p") == 0, "no images").alias("error")
    )


def both_methods(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """(document_id, native_text, native_coverage, native_error, ocr_text, ocr_error): the two methods side by side, each as far as it came."""
    n = native.select("document_id", F.col("text").alias("native_text"), F.col("coverage").alias("native_coverage"), F.col("error").alias("native_error"))
    o = ocr.select("document_id", F.col("text").alias("ocr_text"), F.col("error").alias("ocr_error"))
    return n.join(o, "document_id", "full")


def source_text(extractions: DataFrame, pages: DataFrame) -> DataFrame:
    """Extractions (stem, place, ...) with the text of the page at that place; null where there is none."""
    return extractions.join(pages.select("stem", "place", F.col("text").alias("source_page")), ["stem", "place"], "left")


def method_differences(pages: DataFrame) -> DataFrame:
    """Pages with cer_gain and wer_gain, what the recognised text saves, and the better method; ties go to the native one."""
    gain = lambda m: F.col(f"{m}_native") - F.col(f"{m}_ocr")
    return pages.withColumns({"cer_gain": gain("cer"), "wer_gain": gain("wer"), "better": F.when(gain("cer") > 0, "ocr").otherwise("native")})


def failures(pages: DataFrame, method: str, worst: float = 0.9) -> DataFrame:
    """Pages on which a method failed or whose character error rate exceeds ``worst``."""
    return pages.where(~F.coalesce(F.col(f"{method}_success"), F.lit(False)) | (F.col(f"cer_{method}") > worst))


def flat_metrics(pages: DataFrame) -> DataFrame:
    """Pages whose struct ``metrics`` is spread into columns."""
    return pages.select(*[c for c in pages.columns if c != "metrics"], "metrics.*")


def evaluate_predictions(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(document_id, page_number, metrics...) of pages that both tables have; pages pair by key."""
    both = predicted.join(truth.select("document_id", "page_number", F.col("text").alias("truth")), ["document_id", "page_number"])
    return both.select(
        "document_id", "page_number", metrics.all_metrics(F.col("text"), F.col("truth")).alias("metrics")
    ).select("document_id", "page_number", "metrics.*")


def extraction_benchmark(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """Results (method, document_id, total_pages, processing_time, memory_peak, cer, wer, similarity, pages_per_second, n_errors) of
    runs (method, document_id, total_pages, processing_time, memory_peak, text, errors) against (document_id, truth); without a truth the metrics are null."""
    both = runs.join(truth, "document_id", "left")
    known = F.col("truth").isNotNull()
    measure = lambda f: F.when(known, f(F.when(known, F.col("text")), F.when(known, F.col("truth"))))
    return both.select(
        "method", "document_id", "total_pages", "processing_time", "memory_peak",
        measure(metrics.cer).alias("cer"), measure(metrics.wer).alias("wer"), measure(metrics.similarity).alias("similarity"),
        T.ratio(F.col("total_pages"), F.col("processing_time")).alias("pages_per_second"), F.size("errors").alias("n_errors"),
    )


def corpus_profile(pages: DataFrame) -> DataFrame:
    """(batch, documents, pages, min_pages, median_pages, max_pages) of pages (batch, document_id)."""
    per = pages.groupBy("batch", "document_id").agg(F.count("*").alias("n"))
    return per.groupBy("batch").agg(
        F.count("*").alias("documents"), F.sum("n").alias("pages"), F.min("n").alias("min_pages"), F.median("n").alias("median_pages"),
        F.max("n").alias("max_pages")
    )
