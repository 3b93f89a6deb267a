"""Annotation stores: saving with metrics, aggregates and export.

Gold A compares the texts of two methods with an edited one; gold B judges extracted entities and relations of pages. A store is a
table with one row a key; saving is an upsert by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import text as T
from .files import upsert
from .knowledge import schema_valid

A_KEY, B_KEY = ["pdf_path", "page_number"], ["document_id", "page_number"]


def with_text_metrics(rows: DataFrame) -> DataFrame:
    """Gold-A rows with cer and wer of both methods against ``edited_text``; a method that failed has 1."""

    def rate(measure, method: str) -> Column:
        ok = F.coalesce(F.col(f"{method}_success"), F.lit(False))
        return F.when(ok, measure(F.when(ok, F.col(f"{method}_text")), F.when(ok, F.col("edited_text")))).otherwise(1.0)

    return rows.withColumns({f"{m}_{method}": rate(f, method) for method in ("native", "ocr") for m, f in (("cer", metrics.cer), ("wer", metrics.wer))})


def save_texts(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The gold-A store after saving ``rows``; of one page the latest row by timestamp stays."""
    return upsert(store, with_text_metrics(rows), A_KEY, "timestamp")


def training_export(store: DataFrame) -> DataFrame:
    """Gold-A rows under the names of the training format, with their rates nested."""
    nested = F.struct("cer_native", "cer_ocr", "wer_native", "wer_ocr").alias("metrics")
    return store.select(
        "pdf_path", "page_number", F.col("edited_text").alias("ground_truth"), F.col("native_text").alias("native_raw"),
        F.col("ocr_text").alias("ocr_raw"), "native_success", "ocr_success", "ocr_error", nested, "selected_method"
    )


def _scores(items: str, missing: str, partial: bool) -> dict[str, Column]:
    n = F.size(items)
    count = lambda *names: F.size(F.filter(items, lambda x: x["judgment"].isin(*names)))
    precision = T.ratio(count("correct", "partial") if partial else count("correct"), n)
    recall = T.ratio(count("correct"), count("correct") + F.size(missing))
    return {"precision": precision, "recall": recall, "f1": T.f1(precision, recall)}


def with_judgment_metrics(rows: DataFrame) -> DataFrame:
    """Gold-B rows with precision, recall and f1 of entities and relations, hallucination over both, and schema validity, to four places.

    ``entity_annotations`` and ``relation_annotations`` are arrays of structs with judgment, is_hallucinated and entity_type or
    relation_type; null arrays count as empty. No judgments give 0, and a validity of 1. A partial entity counts for precision; a
    partial relation does not.
    """
    lists = ["entity_annotations", "relation_annotations", "missing_entities", "missing_relations"]
    rows = rows.withColumns({c: F.coalesce(c, F.array()) for c in lists})
    out = {f"entity_{k}": F.round(v, 4) for k, v in _scores("entity_annotations", "missing_entities", True).items()}
    out |= {f"relation_{k}": F.round(v, 4) for k, v in _scores("relation_annotations", "missing_relations", False).items()}
    n = F.size("entity_annotations") + F.size("relation_annotations")
    flagged = lambda c: F.size(F.filter(c, lambda x: F.coalesce(x["is_hallucinated"], F.lit(False))))
    valid = F.size(F.filter("entity_annotations", lambda x: schema_valid(x["entity_type"]))) + F.size(
        F.filter("relation_annotations", lambda x: schema_valid(x["relation_type"]))
    )
    out["hallucination_rate"] = F.round(T.ratio(flagged("entity_annotations") + flagged("relation_annotations"), n), 4)
    out["schema_validity_rate"] = F.round(T.ratio(valid, n, 1.0), 4)
    return rows.withColumns(out)


def save_judgments(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The gold-B store after saving ``rows``; of one page the latest row by timestamp stays."""
    return upsert(store, with_judgment_metrics(rows), B_KEY, "timestamp")


def store_statistics(store: DataFrame) -> DataFrame:
    """One row: all pages, those with an f1, and the means of their metrics, to four places."""
    names = [f"{kind}_{m}" for kind in ("entity", "relation") for m in ("f1", "precision", "recall")] + ["hallucination_rate", "schema_validity_rate"]
    scored = F.col("entity_f1").isNotNull()
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(scored, F.col(c))), F.lit(0.0)), 4).alias(f"mean_{c}")
    return store.agg(F.count("*").alias("total"), F.count_if(scored).alias("annotated"), *map(mean, names))


def relation_scores(judged: DataFrame, missing: DataFrame) -> DataFrame:
    """(page, n, precision, recall, f1) of relation judgments (page, judgment); correct alone counts. ``missing`` has (page, n_missing)."""
    own = judged.groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("judgment") == "correct").alias("correct"))
    both = own.join(missing, "page", "left").fillna(0, ["n_missing"])
    precision, recall = T.ratio(F.col("correct"), F.col("n")), T.ratio(F.col("correct"), F.col("correct") + F.col("n_missing"))
    return both.select("page", "n", precision.alias("precision"), recall.alias("recall"), T.f1(precision, recall).alias("f1"))


def missing_items(text: Column | str, fields: list[str]) -> Column:
    """Lines ``a | b`` (| c) as structs of ``fields``; lines of fewer parts or a blank first part go."""
    parts = F.transform(F.split(F.coalesce(T.strip(text), F.lit("")), "\\r?\\n"), lambda line: F.transform(F.split(line, "\\|"), lambda p: T.strip(p)))
    whole = F.filter(parts, lambda p: (F.size(p) >= len(fields)) & (p[0] != ""))
    return F.transform(whole, lambda p: F.struct(*[p[i].alias(f) for i, f in enumerate(fields)]))
