"""Routing of page extraction and rule-based entity extraction.

Unless an operator says otherwise: null flags count as false, null coverages as 0, null texts hold nothing, documents have unique ids, and
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NATIVE_THRESHOLD = 0.8
MAX_MB, MAX_PAGES = 50, 20
# The patterns of the rule-based extractor, in the order in which they claim a value.
EMAIL = rf"[{T.WORD}.\-]+@[{T.WORD}.\-]+\.[{T.WORD}]+"
_GAP = r"\s\x1c-\x1f\x85\p{Z}"
REFERENCES = {
    "purchase_order": rf"(?i)(?:P\.?O\.?|Purchase Order)[#{_GAP}:No.]*([A-Z0-9\-]{{4,}})",
    "invoice": rf"(?i)(?:Invoice|INV)[#{_GAP}:No.]*([A-Z0-9\-]{{4,}})",
    "contract": rf"(?i)(?:Contract)[#{_GAP}:ID]*([A-Z0-9\-]{{4,}})",
}


def route(native_ok: Column, coverage: Column, ocr_ok: Column, threshold: float = NATIVE_THRESHOLD) -> Column:
    """Which text a document gets: native at enough coverage, else recognised, else native with an error, else failed."""
    cov = F.coalesce(coverage, F.lit(0.0))
    return F.when(native_ok & (cov >= threshold), "native").when(ocr_ok, "ocr").when(native_ok, "native_fallback").otherwise("failed")


def batch_plan(method: Column, coverage: Column, threshold: float = NATIVE_THRESHOLD) -> Column:
    """What a batch does with a document: run recognition, or skip it with a marker."""
    return F.when(method == "native", "native_only").when(
        (method == "hybrid") & (F.coalesce(coverage, F.lit(0.0)) >= threshold), "skipped_due_to_high_native_coverage"
    ).otherwise("run_ocr")


def file_guard(size_bytes: Column, pages: Column, max_mb: float = MAX_MB, max_pages: int = MAX_PAGES) -> Column:
    """Why a file is skipped, or null."""
    return F.when(size_bytes / 1048576.0 > max_mb, "file too large").when(pages > max_pages, "too many pages")


def document_summary(pages: DataFrame) -> DataFrame:
    """Per document_id of pages (page_number, native_ok, ocr_ok, coverage): rates, mean and summed coverage, failed pages."""
    ok = lambda c: F.concat(F.count_if(F.col(c)).cast("string"), F.lit("/"), F.count("*").cast("string"))
    failed = lambda c: F.array_sort(F.collect_list(F.when(~F.coalesce(F.col(c), F.lit(False)), F.col("page_number"))))
    return pages.groupBy("document_id").agg(
        ok("native_ok").alias("native_success_rate"), ok("ocr_ok").alias("ocr_success_rate"),
        F.avg("coverage").alias("average_native_coverage"), F.sum("coverage").alias("summed_native_coverage"),
        failed("native_ok").alias("native_failed_pages"), failed("ocr_ok").alias("ocr_failed_pages")
    )


def join_pages(pages: DataFrame) -> DataFrame:
    """(document_id, text): page texts in order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


def rule_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, type, name, kind, source_text, confidence) from (doc_id, text): the document itself, e-mails as persons, references.

    Values are kept where first seen; all reference kinds share what they have seen, so an earlier kind wins.
    """
    found = [
        F.transform(
            F.regexp_extract_all(F.col("text"), F.lit(EMAIL), F.lit(0)),
            lambda m: F.struct(F.lit(0).alias("pat"), F.lit("Person").alias("type"), F.lit("email").alias("kind"), m.alias("value"), m.alias("source_text"))
        )
    ]
    for i, (kind, pattern) in enumerate(REFERENCES.items(), 1):
        values, whole = (F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(g)) for g in (1, 0))
        found.append(F.zip_with(values, whole, _reference(i, kind)))
    rows = docs.select("doc_id", F.posexplode(F.concat(*found)).alias("pos", "m")).select("doc_id", "pos", "m.*")
    first = Window.partitionBy("doc_id", F.col("pat") == 0, "value").orderBy("pos")
    kept = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    order = Window.partitionBy("doc_id").orderBy("pos")
    name = F.when(F.col("pat") == 0, F.element_at(F.split("value", "@"), 1)).otherwise(F.col("value"))
    parts = kept.select("doc_id", F.row_number().over(order).alias("ord"), "type", name.alias("name"), "kind", "source_text", F.lit(0.6).alias("confidence"))
    own = docs.select(
        "doc_id", F.lit(0).alias("ord"), F.lit("Document").alias("type"), F.col("doc_id").cast("string").alias("name"),
        F.lit("document").alias("kind"), F.lit("").alias("source_text"), F.lit(1.0).alias("confidence")
    )
    return own.unionByName(parts)


def _reference(i: int, kind: str):
    return lambda v, w: F.struct(F.lit(i).alias("pat"), F.lit("Reference").alias("type"), F.lit(kind).alias("kind"), v.alias("value"), w.alias("source_text"))


def rule_relations(entities: DataFrame) -> DataFrame:
    """(doc_id, ord, source, rel_type, target): each found entity from its document."""
    rel = F.when(F.col("type") == "Person", "MENTIONS_PERSON").otherwise("HAS_REFERENCE")
    return entities.where("ord > 0").select(
        "doc_id", "ord", F.col("doc_id").cast("string").alias("source"), rel.alias("rel_type"), F.col("name").alias("target")
    )


def parse_answer(answer: Column | str, schema: str) -> Column:
    """A model's JSON answer as a struct: as it stands, else its widest braces; null if neither parses.

    Each step is the variable of a lambda over the one before, so that it is worked out once a row.
    """
    once = lambda value, fn: F.get(F.transform(F.array(value), fn), F.lit(0))
    read = lambda text: F.from_json(F.when(F.is_valid_utf8(text) & F.try_parse_json(text).isNotNull(), text), schema)
    return once(T.strip_wrappers(answer), lambda clean: F.coalesce(read(clean), once(F.regexp_extract(clean, r"(?s)\{.*\}", 0), read)))
