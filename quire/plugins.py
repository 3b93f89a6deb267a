"""Injected models, each with an offline default."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.extraction import rule_entities


class Extractor(Protocol):
    def __call__(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text) to entities."""


class Retriever(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame:
        """(query_id, text) to (query_id, rank, id, score)."""


class Generator(Protocol):
    def __call__(self, prompt: str) -> Iterator[str]:
        """A prompt to a stream of text."""


rule_extractor: Extractor = rule_entities


def retry(call: Callable, attempts: int = 4, first_wait: float = 2.0, longest: float = 60.0, fatal: tuple = (), wait: Callable[[float], None] = time.sleep):
    """``call`` with exponential back-off; exceptions of the ``fatal`` kinds are not retried.

    An exception with a ``retry_after`` in seconds is waited for as long as it says, ``longest`` at most.
    """

    def run(*args, **kwargs):
        for i in range(attempts):
            try:
                return call(*args, **kwargs)
            except fatal:
                raise
            except Exception as e:
                if i + 1 == attempts:
                    raise
                told = getattr(e, "retry_after", None)
                wait(min(longest, first_wait * 2**i if told is None else float(told)))

    return run


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]:
        """Texts to vectors of one length."""


def embed(docs: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, v) of (id, text), batch by batch; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "v": embedder(pdf["text"].fillna("").tolist())})

    return docs.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, v array<double>")


class Providers:
    """Generators by name, one of which is in use."""

    def __init__(self, generators: dict[str, Generator], use: str) -> None:
        self.generators = dict(generators)
        self.switch(use)

    def switch(self, name: str) -> None:
        if name not in self.generators:
            raise KeyError(f"no provider {name}; there are {', '.join(sorted(self.generators))}")
        self.name = name

    def __call__(self, prompt: str) -> Iterator[str]:
        return iter(self.generators[self.name](prompt))


def generate_answers(prompts: DataFrame, generate: Generator) -> DataFrame:
    """(query_id, prompt, answer, error) of (query_id, prompt); an answer that fails is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for query_id, prompt in zip(pdf["query_id"], pdf["prompt"], strict=True):
                try:
                    rows.append((query_id, prompt, "".join(generate(prompt)), None))
                except Exception as e:  # one bad answer is a row, not a failed job
                    rows.append((query_id, prompt, None, str(e)))
            yield pd.DataFrame(rows, columns=["query_id", "prompt", "answer", "error"])

    return prompts.select("query_id", "prompt").mapInPandas(
        run, f"query_id {prompts.schema['query_id'].dataType.simpleString()}, prompt string, answer string, error string"
    )


def stream_answer(prompt: str, generate: Generator, whole: Callable[[str], str] | None = None) -> Iterator[dict]:
    """Events of one answer: a ``token`` for each piece, then ``done`` with the whole text.

    If nothing could be streamed, ``whole`` is asked for the answer at once.
    """
    pieces: list[str] = []
    try:
        for piece in generate(prompt):
            pieces.append(piece)
            yield {"event": "token", "data": piece}
    except Exception:
        if pieces or whole is None:
            raise
        pieces = [whole(prompt)]
        yield {"event": "token", "data": pieces[0]}
    yield {"event": "done", "data": "".join(pieces)}
