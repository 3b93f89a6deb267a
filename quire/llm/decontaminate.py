"""Benchmark decontamination with a generalised suffix automaton over test-item words.

The automaton holds every word sequence of the items. Training words stream through it, which tracks
the longest item passage that ends at each word. Runs of words are first cut at word pairs that no item
holds, since no longer match can cross one; what remains streams through the automaton. Tasks build the automata of
blocks of items and freeze them into arrays; a pass over the documents carries ``PASS_BLOCKS`` of them.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extended, map_rows, materialize, utf8

WINDOW = 10
BLOCK_WORDS = 500_000
"""Item words in one automaton, on average; frozen it takes some 100 MB at most. More items make further automata."""
CHARS_PER_WORD = 6
PASS_BLOCKS = 2
"""Automata that are broadcast at once; beyond, documents are passed over again."""
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words: maximal runs of 0-9, a-z and code points from U+0080 after A-Z are lower-cased."""
    return (text or b"").translate(_WORDS).split()


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of ``words_of``."""
    inside = np.r_[False, np.frombuffer(text.translate(_WORDS), np.uint8) != 32, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences, built online one sequence after another."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is None:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p == -1:
                return cur
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
                return cur
        else:
            cur, p = -1, last
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        if cur != -1:
            link[cur] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone if cur == -1 else cur

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def freeze(self) -> None:
        """Turn the transitions into arrays sorted by state and word."""
        sizes = [len(n) for n in self.next]
        self.first = array("i", [0, *accumulate(sizes)])
        self.symbol, self.target = array("i"), array("i")
        for own in self.next:
            for c in sorted(own):
                self.symbol.append(c)
                self.target.append(own[c])
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.next = []

    def step(self, state: int, c: int) -> int:
        """The state after the word c, or -1."""
        end = self.first[state + 1]
        i = bisect_left(self.symbol, c, self.first[state], end)
        return self.target[i] if i < end and self.symbol[i] == c else -1

    def stream(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest item passage that ends here) after each word; of a frozen automaton."""
        link, length, step = self.link, self.length, self.step
        state = match = 0
        for c in sequence:
            to = step(state, c)
            while to < 0 and state:
                state = link[state]
                match = length[state]
                to = step(state, c)
            if to >= 0:
                state = to
                match += 1
            yield state, match

    def suffix_state(self, state: int, size: int) -> int:
        """The state of the suffix of ``size`` words of a passage that ends in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state


class ItemIndex:
    """The automaton of one block of items with the windows that count as hits."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        self.automaton = SuffixAutomaton()
        for sequence in ids:
            self.automaton.add(sequence)
        self.automaton.freeze()
        self.names = [name for name, _ in items]
        self.sizes = sorted({min(len(s), window) for s in ids}, reverse=True)
        self.windows: dict[int, tuple[int, ...]] = {}
        for item, sequence in enumerate(ids):
            size = min(len(sequence), window)
            for at, (state, match) in enumerate(self.automaton.stream(sequence)):
                if at + 1 >= size and match >= size:
                    key = self._key(state, size)
                    held = self.windows.get(key, ())
                    if item not in held[-1:]:
                        self.windows[key] = (*held, item)
        pairs = {a * len(self.vocabulary) + b for s in ids for a, b in pairwise(s)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _key(self, state: int, size: int) -> int:
        return self.automaton.suffix_state(state, size) << 16 | size

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of window occurrences and the names of the items they belong to."""
        n, least = len(words), self.sizes[-1]
        get = self.vocabulary.get
        ids = np.fromiter([get(w, -1) for w in words], np.int64, n)
        if least > 1:
            code = ids[:-1] * len(self.vocabulary) + ids[1:]
            at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            known = np.zeros(max(n - 1, 0), bool)
            if len(self.pairs):
                place = np.searchsorted(self.pairs, code[at])
                known[at] = self.pairs[np.minimum(place, len(self.pairs) - 1)] == code[at]
        else:
            known = (ids[:-1] >= 0) & (ids[1:] >= 0)
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2] + 1  # words [start, end)
        if least == 1:
            alone = np.flatnonzero((ids >= 0) & ~np.r_[False, known] & ~np.r_[known, False])
            starts, ends = np.r_[starts, alone], np.r_[ends, alone + 1]
        spans, names = [], set()
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a < least:
                continue
            for at, (state, match) in enumerate(self.automaton.stream(ids[a:b].tolist()), a + 1):
                for size in self.sizes:
                    if match >= size and (found := self.windows.get(self._key(state, size))):
                        spans.append((at - size, at))
                        names.update(self.names[i] for i in found)
        return spans, names


def item_indexes(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(block, content): pickled indexes of blocks of the items, built in tasks and written. Items without words are in none."""

    def build(table: pa.Table) -> pa.Table:
        own = [
            ("" if i is None else i, words) for i,
            t in zip(table["item"].to_pylist(), table["text"].cast(pa.binary()).to_pylist(), strict=True) if (words := words_of(t))
        ]
        content = [pickle.dumps(ItemIndex(own, window), 5)] if own else []
        return pa.table({"block": pa.array([table["block"][0].as_py()] * len(content), pa.int32()), "content": pa.array(content, pa.binary())})

    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    number = max(1, -(-chars // (CHARS_PER_WORD * BLOCK_WORDS)))
    rows = items.where("text is not null").select(
        F.col("item_id").cast("string").alias("item"), "text",
        F.pmod(F.xxhash64("item_id", "text"), F.lit(number)).cast("int").alias("block")
    )
    return materialize(rows.groupBy("block").applyInArrow(build, "block int, content binary"), "item-indexes")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """Every row and column of ``docs`` with n_words, n_hit, items, clean_text, coverage and contaminated.

    A window is ``window`` consecutive words of an item; a shorter item with any word is one window. A
    document word inside an occurrence of a window is hit. items: ids (as strings, sorted) of the items
    with an occurring window. clean_text is the text without the spans from the first to the last hit
    word of each run of hit words; it is null where hit words exceed ``max_coverage`` of all words, which marks a
    document to drop. Null or empty text has no words and stays as it is; a null item_id is the empty
    string; items without words, or no items, hit nothing. Equal rows are treated alike; columns of the
    added names are replaced.
    """
    added = "n_words long, n_hit long, items array<string>, clean_text string, coverage double, contaminated boolean"
    names = [c.split()[0] for c in added.split(", ")]
    docs = docs.drop(*names)
    indexes = item_indexes(items, window)
    blocks = sorted(r.block for r in indexes.select("block").collect())  # one number a block of items
    carried = docs
    while len(blocks) > PASS_BLOCKS:
        now, blocks = blocks[:PASS_BLOCKS], blocks[PASS_BLOCKS:]
        carried = materialize(_with_hits(carried, _broadcast(indexes, now)), "hits")
    shared = _broadcast(indexes, blocks)
    given = docs.columns
    text_at, spans_at = given.index("text"), len(given) if carried is not docs else None
    held: list[ItemIndex] = []

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.extend(pickle.loads(b.value) for b in shared)
        rows = []
        before = _carried(batch, spans_at)
        for text, (spans, found) in zip(utf8(batch.column(text_at)), before, strict=True):
            words = words_of(text)
            for index in held:
                more, names_found = index.hits(words)
                spans += more
                found |= names_found
            n, clean, hit = len(words), text, 0
            if spans:
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, [a for a, _ in spans], 1)
                np.add.at(step, [b for _, b in spans], -1)
                inside = np.cumsum(step[:-1]) > 0
                hit = int(inside.sum())
                if hit > max_coverage * n:
                    clean = None
                else:
                    begin, end = word_spans(text)
                    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
                    keep, at = [], 0
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        keep.append(text[at : begin[a]])
                        at = end[b - 1]
                    clean = b"".join([*keep, text[at:]])
            rows.append((n, hit, sorted(found), clean, hit / n if n else 0.0, hit > 0))
        c = list(zip(*rows, strict=True))
        more = [
            pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(pa.string())),
            pa.array(c[3], pa.binary()).cast(pa.string()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.bool_())
        ]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(given)], *more], [*given, *names])

    return map_rows(carried, of, extended(docs, added))


def _broadcast(indexes: DataFrame, blocks: list[int]) -> list:
    """The pickled indexes of at most ``PASS_BLOCKS`` blocks."""
    rows = indexes.where(F.col("block").isin(blocks)).select("content").collect() if blocks else []
    return [indexes.sparkSession.sparkContext.broadcast(bytes(r.content)) for r in rows]


def _carried(batch: pa.RecordBatch, spans_at: int | None) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """Spans and item names that earlier passes found."""
    if spans_at is None:
        return [([], set()) for _ in range(batch.num_rows)]
    flat, names = batch.column(spans_at).to_pylist(), batch.column(spans_at + 1).to_pylist()
    return [(list(zip(x[::2], x[1::2], strict=True)), set(n)) for x, n in zip(flat, names, strict=True)]


def _with_hits(docs: DataFrame, shared: list) -> DataFrame:
    """Documents with what a pass adds to __spans (begin and end of each in turn) and __items."""
    columns = [c for c in docs.columns if c not in ("__spans", "__items")]
    text_at, spans_at = columns.index("text"), len(columns) if len(columns) < len(docs.columns) else None
    held: list[ItemIndex] = []

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.extend(pickle.loads(b.value) for b in shared)
        spans, names = [], []
        for text, (own, found) in zip(utf8(batch.column(text_at)), _carried(batch, spans_at), strict=True):
            words = words_of(text)
            for index in held:
                more, names_found = index.hits(words)
                own += more
                found |= names_found
            spans.append([x for s in own for x in s])
            names.append(sorted(found))
        more = [pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *more], [*columns, "__spans", "__items"])

    return map_rows(docs, of, extended(docs.select(*columns), "__spans array<long>, __items array<string>"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of benchmark items in all documents; edge cases as of ``decontaminate``."""
    found = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str, bool]]:
    """The same result by comparing every window with every place."""
    windows: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        words = words_of((text or "").encode())
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item_id))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        words, hit, found = words_of((text or "").encode()), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if names := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= names
        out[doc_id] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out
