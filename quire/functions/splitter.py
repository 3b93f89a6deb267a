"""Recursive character splitting of page text into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

SIZE, OVERLAP = 800, 150
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters cut at the coarsest separator that occurs; a separator opens the next piece."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    chunks: list[str] = []
    window: list[str] = []
    held = 0

    def close() -> None:
        whole = "".join(window).strip()
        if whole:
            chunks.append(whole)

    for piece in _pieces(text, separators[at]):
        n = len(piece)
        if n >= size and (finer or n > size):
            close()
            window, held = [], 0
            chunks += split_text(piece, size, overlap, finer) if finer else [piece]
            continue
        if held + n > size:
            close()
            while window and (held > overlap or held + n > size):
                held -= len(window.pop(0))
        window.append(piece)
        held += n
    close()
    return chunks


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = 50) -> DataFrame:
    """(chunk_id, text, document_id, page_number, chunk_index) from pages (document_id, page_number, text).

    Pages, and then chunks, of under ``least`` stripped characters go; a dropped chunk leaves a gap in the numbers.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(chunk=[list(enumerate(split_text(t, size, overlap))) for t in pdf["text"]]).explode("chunk").dropna(subset="chunk")
            yield pd.DataFrame(
                {
                    "document_id": pdf["document_id"], "page_number": pdf["page_number"], "chunk_index": [c[0] for c in pdf["chunk"]],
                    "text": [c[1] for c in pdf["chunk"]]
                }
            )

    long_enough = F.length(T.strip("text")) >= least
    rows = pages.where(long_enough).select(
        F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), "text"
    )
    chunks = rows.mapInPandas(split, "document_id string, page_number int, chunk_index int, text string").where(long_enough)
    return chunks.select(T.chunk_id("document_id", "page_number", "chunk_index").alias("chunk_id"), "text", "document_id", "page_number", "chunk_index")
