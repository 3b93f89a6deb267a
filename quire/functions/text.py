"""Text expressions, all but one in the JVM, with the white-space and word classes of Unicode."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"\p{L}\p{N}_"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column | str) -> Column:
    """Lower-cased words between white space; no stop words, stemming or punctuation stripping."""
    return F.filter(F.split(F.lower(col(text)), f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(col(text), f"{SPACE}+"), lambda w: w != ""))


def normalize_text(text: Column | str) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(col(text), f"{SPACE}+", " "))


def normalize_name(name: Column | str) -> Column:
    """Lower case, punctuation to blanks, white space collapsed."""
    return normalize_text(F.regexp_replace(strip(F.lower(col(name))), rf"[^{WORD}\s\x1c-\x1f\x85\p{{Z}}]", " "))


def fragment_key(name: Column | str) -> Column:
    return F.lower(F.trim(col(name)))


def page_coverage(chars: Column | str, width: Column, height: Column) -> Column:
    area = width * height
    return F.when(area > 0, F.round(F.least(col(chars) * 20 / area, F.lit(1.0)), 4)).otherwise(F.lit(0.0))


_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
"""The characters of ``SPACE``."""


def _top_share(text: str | None) -> float | None:
    """Share of the most frequent character in what is not white space; none if there is no such character."""
    if not text:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.max() < 1 << 16:
        counts = np.bincount(points)
        counts[_SPACES[_SPACES < len(counts)]] = 0
    else:
        points, counts = np.unique(points, return_counts=True)
        counts[np.isin(points, _SPACES)] = 0
    n = counts.sum()
    return float(counts.max() / n) if n else None


@F.pandas_udf(DoubleType())
def top_share(text: pd.Series) -> pd.Series:
    return pd.Series([_top_share(t) for t in text], dtype="float64")


def is_garbage(text: Column | str, most: float = 0.4, at_least: int = 200) -> Column:
    """Texts of 200 characters or more that are blank, or of which one character makes up over 40 % of what is not white space.

    Characters are counted once a text in an Arrow UDF, which shorter texts do not reach.
    """
    long = F.length(col(text)) >= at_least
    return F.coalesce(long & F.coalesce(top_share(F.when(long, col(text))) > most, F.lit(True)), F.lit(False))


def pick_for_index(native: Column | str, ocr: Column | str, prefer: str = "longer") -> Column:
    """Native or recognised text of a page: garbage gives way, then the preference decides."""
    a, b = F.coalesce(col(native), F.lit("")), F.coalesce(col(ocr), F.lit(""))
    choice = {
        "native": F.when(a != "", a).otherwise(b), "ocr": F.when(b != "", b).otherwise(a),
        "longer": F.when(F.length(a) >= F.length(b), a).otherwise(b)
    }[prefer]
    return F.when(is_garbage(a), b).otherwise(choice)


def pick_for_graph(native: Column | str, ocr: Column | str, limit: int = 8000) -> Column:
    a, b = F.coalesce(col(native), F.lit("")), F.coalesce(col(ocr), F.lit(""))
    return F.substring(F.when(F.length(b) > F.length(a), b).otherwise(a), 1, limit)


def pick_for_export(native: Column | str, ocr: Column | str) -> Column:
    return F.coalesce(F.nullif(col(ocr), F.lit("")), col(native), F.lit(""))


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(col(text)) / 4)


def document_of_chunk(document_id: Column | str, chunk_id: Column | str) -> Column:
    return F.coalesce(F.nullif(col(document_id), F.lit("")), F.regexp_replace(col(chunk_id), "_chunk_(?!.*_chunk_).*$", ""))


def chunk_id(stem: Column | str, page: Column | str, number: Column | str) -> Column:
    return F.concat(col(stem), F.lit("_page_"), col(page).cast("string"), F.lit("_chunk_"), col(number).cast("string"))


def path_batch(path: Column | str) -> Column:
    p = col(path)
    return F.when(F.contains(p, F.lit("batch2")), "batch2").when(F.contains(p, F.lit("batch3")), "batch3").when(F.contains(p, F.lit("batch4")), "batch4").otherwise("unknown")


def path_type(path: Column | str) -> Column:
    """The parent folder, or for a batch folder the file name up to its first hyphen."""
    parts = F.split(col(path), "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    name = F.element_at(parts, -1)
    return F.when(
        (parent != "") & ~parent.isin("batch2", "batch3", "batch4"), parent
    ).when(F.contains(name, F.lit("-")), F.element_at(F.split(name, "-"), 1)).otherwise("unknown")


def batch_folder(path: Column | str) -> Column:
    return F.regexp_extract(col(path), "/batch[^/]*/([^/]+)", 1)


def slug(path: Column | str) -> Column:
    return F.lower(F.replace(col(path), F.lit("/"), F.lit("_")))


def strip_wrappers(text: Column | str) -> Column:
    """A model's answer without thinking blocks and code fences."""
    return strip(F.regexp_replace(F.regexp_replace(col(text), "(?s)<think>.*?</think>", ""), r"(?m)^\s*```(?:json)?\s*$|```(?:json)?", ""))


def clean_entity_name(name: Column | str, type_: Column | str, document_id: Column | str) -> Column:
    return strip(F.translate(F.when(col(type_) == "Document", F.coalesce(F.nullif(col(document_id), F.lit("")), col(name))).otherwise(col(name)), "\"'", ""))


def preview(text: Column | str, size: int = 400, dots: bool = False) -> Column:
    t = F.left(col(text), F.lit(size))
    return F.concat(t, F.lit("...")) if dots else t


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)
