"""Language identification with a linear-chain conditional random field over words.

Affix, character n-gram, whole-word and lexicon features score each word for each language; learned transitions
let the label switch inside a text. It is trained on word sequences spliced from documents of several languages;
forward-backward gives every word's label distribution: its peak labels the word, and their mean labels the text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, extended, map_rows

BUCKETS = 1 << 17
DOCS_PER_LANGUAGE = 300
"""The training sample: at most so many whole documents of each language, chosen by a hash of doc_id."""
WORDS_PER_DOC = 200
"""Training words drawn a document and epoch, from anywhere in the sampled texts."""
LEXICON_DOCS = 3
"""A word in so many sampled documents of a language is in its lexicon."""
LONG_WORD = 64
"""A longer word is described by its first and last half of so many characters."""
SAMPLE_DOCS = 64 * DOCS_PER_LANGUAGE
"""With over 64 languages, each has an equal part of so many documents."""
MAX_LANGUAGES = 256
"""Bound by the memory of weights and transitions on the driver; more labels are an error, none is left out."""
FOLDS, HELD_OUT = 4, 2
_WORD = re.compile(r"[^\W\d_]+")
MAX_CELLS = 1 << 19
MAX_WORDS = 400_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def word_features(word: str) -> list[int]:
    """Hashed features: the word, prefixes and suffixes up to three characters, 2- and 3-grams with word ends."""
    if len(word) > LONG_WORD:
        word = word[: LONG_WORD // 2] + word[-LONG_WORD // 2 :]
    edged = f"<{word}>"
    names = ["w" + word]
    names += ["p" + word[:n] for n in (1, 2, 3)] + ["s" + word[-n:] for n in (1, 2, 3)]
    names += [edged[i : i + 2] for i in range(len(edged) - 1)] + [edged[i : i + 3] for i in range(len(edged) - 2)]
    return [zlib.crc32(n.encode()) & (BUCKETS - 1) for n in names]


class Crf:
    def __init__(self, languages: list[str]) -> None:
        k = len(languages)
        self.languages = languages
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.transitions = np.eye(k, dtype=np.float32) * 2
        self.lexicon: dict[str, int] = {}

    def features(self, word: str) -> list[int]:
        own, entry = word_features(word), self.lexicon.get(word)
        return own if entry is None else [*own, entry]

    def learn_lexicon(self, samples: list[tuple[list[str], int]]) -> None:
        """Words of the lexicons, each with the hashed feature of the languages that list it."""
        seen: dict[tuple[str, int], int] = {}
        for words, y in samples:
            for w in set(words):
                seen[w, y] = seen.get((w, y), 0) + 1
        listed: dict[str, list[int]] = {}
        for (w, y), n in sorted(seen.items()):
            if n >= LEXICON_DOCS:
                listed.setdefault(w, []).append(y)
        self.lexicon = {w: zlib.crc32(f"l{ys}".encode()) & (BUCKETS - 1) for w, ys in listed.items()}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): sums of feature weights, less the largest of each word."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), 4096):
            features = [self.features(w) for w in words[at : at + 4096]]
            sizes = np.fromiter(map(len, features), np.int64, len(features))
            flat = np.fromiter((f for own in features for f in own), np.int64, int(sizes.sum()))
            out[at : at + len(features)] = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)
        return np.maximum(out - out.max(axis=1, keepdims=True), -30)

    def train(self, samples: list[tuple[list[str], int]], epochs: int = 3, rate: float = 0.2, seed: int = 7) -> None:
        """AdaGrad on the conditional likelihood of spliced sequences; ``samples`` are (words, language number)."""
        rng, k = np.random.default_rng(seed), len(self.languages)
        samples = [s for s in samples if s[0]]
        if not samples:
            return
        vocabulary: dict[str, int] = {}
        texts = [(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]), y) for words, y in samples]
        self.learn_lexicon(samples)
        features = [self.features(w) for w in vocabulary]
        width = max(map(len, features))
        table = np.full((len(features), width), BUCKETS, np.int64)
        for r, own in enumerate(features):
            table[r, : len(own)] = own
        weights, transitions = np.zeros((BUCKETS + 1, k)), self.transitions.astype(np.float64)
        g_weights, g_transitions = np.full((BUCKETS + 1, k), 1e-2), np.full((k, k), 1.0)
        length, lanes = 48, 64
        rounds = max(1, sum(min(len(t), WORDS_PER_DOC) for t, _ in texts) // (length * lanes)) * epochs
        for _ in range(rounds):
            x, y = np.empty((length, lanes), np.int64), np.empty((length, lanes), np.int64)
            for lane in range(lanes):
                at = 0
                while at < length:
                    words, label = texts[rng.integers(len(texts))]
                    n = int(min(rng.integers(4, length + 1), length - at, len(words)))
                    start = int(rng.integers(len(words) - n + 1))
                    x[at : at + n, lane], y[at : at + n, lane] = words[start : start + n], label
                    at += n
            used, inverse = np.unique(x, return_inverse=True)
            scores = weights[table[used]].sum(axis=1)
            e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))[inverse.reshape(x.shape)]
            a = np.exp(transitions)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            alpha[0] = e[0] / e[0].sum(axis=1, keepdims=True)
            for t in range(1, length):
                alpha[t] = alpha[t - 1] @ a * e[t]
                alpha[t] /= alpha[t].sum(axis=1, keepdims=True)
            pairs = np.zeros((k, k))
            for t in range(length - 2, -1, -1):
                ahead = e[t + 1] * beta[t + 1]
                joint = alpha[t][:, :, None] * a * ahead[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                beta[t] = ahead @ a.T
                beta[t] /= beta[t].sum(axis=1, keepdims=True)
            gamma = alpha * beta
            gamma /= gamma.sum(axis=2, keepdims=True)
            slope = -gamma
            np.put_along_axis(slope, y[:, :, None], np.take_along_axis(slope, y[:, :, None], 2) + 1, 2)
            by_word = np.stack([np.bincount(inverse.ravel(), slope[:, :, c].ravel(), len(used)) for c in range(k)], axis=1)
            touched, place = np.unique(table[used], return_inverse=True)
            grad = np.stack([np.bincount(place.ravel(), np.repeat(by_word[:, c], width), len(touched)) for c in range(k)], axis=1) - 1e-3 * weights[touched]
            g_weights[touched] += grad * grad
            weights[touched] += rate * grad / np.sqrt(g_weights[touched])
            weights[BUCKETS] = 0
            observed = np.bincount((y[:-1] * k + y[1:]).ravel(), minlength=k * k).reshape(k, k)
            step = observed - pairs - 1e-2 * transitions
            g_transitions += step * step
            transitions += rate * step / np.sqrt(g_transitions)
        self.weights, self.transitions = weights[:BUCKETS].astype(np.float32), transitions.astype(np.float32)

    def label_shares(self, texts: list[np.ndarray], e: np.ndarray, sure: np.ndarray | None = None, labels: list | None = None) -> np.ndarray:
        """(texts, languages): the mean label distribution of each text's words by forward-backward.

        ``e`` has exp(score) of each word number. Texts of like length run side by side, longest first.
        ``sure``, if given, is filled with the mean share of each word's own best label, ``labels`` with these labels.
        """
        k = e.shape[1]
        out = np.zeros((len(texts), k))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        a = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        at = 0
        while at < len(order):
            longest = int(sizes[order[at]])
            group = order[at : at + max(1, MAX_CELLS // longest)]
            at += len(group)
            own = sizes[group]
            cells = np.zeros((longest, len(group)), np.int32)
            for lane, i in enumerate(group.tolist()):
                cells[: own[lane], lane] = texts[i]
            active = np.searchsorted(-own, -np.arange(longest), side="left")  # lanes longer than t
            alpha = np.empty((longest, len(group), k), np.float32)
            x = e[cells[0]]
            alpha[0] = x / x.sum(axis=1, keepdims=True)
            for t in range(1, longest):
                n = active[t]
                x = (alpha[t - 1, :n] @ a) * e[cells[t, :n]]
                alpha[t, :n] = x / x.sum(axis=1, keepdims=True)
            best = np.zeros((longest if labels is not None else 0, len(group)), np.int16)
            beta, total, peak = np.ones((len(group), k), np.float32), np.zeros((len(group), k)), np.zeros(len(group))
            for t in range(longest - 1, -1, -1):
                n = active[t]
                g = alpha[t, :n] * beta[:n]
                g /= g.sum(axis=1, keepdims=True)
                total[:n] += g
                if sure is not None:
                    peak[:n] += g.max(axis=1)
                if labels is not None:
                    best[t, :n] = g.argmax(axis=1)
                x = (e[cells[t, :n]] * beta[:n]) @ a.T
                beta[:n] = x / x.sum(axis=1, keepdims=True)
            out[group] = total / own[:, None]
            if sure is not None:
                sure[group] = peak / own
            if labels is not None:
                for lane, i in enumerate(group.tolist()):
                    labels[i] = best[: own[lane], lane]
        return out


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(text, lang): a bounded sample of the labelled rows that are not held out."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold != HELD_OUT))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return []
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values; langid learns at most so many")
    most = min(DOCS_PER_LANGUAGE, SAMPLE_DOCS // len(counts))
    h = F.xxhash64("doc_id")
    place = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    share = F.when(F.lit(False), F.lit(0.0))
    for lang, n in counts.items():
        share = share.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * most / n)))
    picked = rows.where(place < share).select("lang", h.alias("h"), "doc_id", "text")
    out: list[tuple[str, str]] = []
    seen: dict[str, int] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["h"], r["doc_id"], r["text"])):
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= most:
            out.append((r["text"], r["lang"]))
    return out


def fit(docs: DataFrame) -> Crf:
    sample = training_sample(docs)
    crf = Crf(sorted({lang for _, lang in sample}))
    number = {lang: i for i, lang in enumerate(crf.languages)}
    crf.train([(words_of(text), number[lang]) for text, lang in sample])
    return crf


def predict(docs: DataFrame, crf: Crf, confidence: str | None = None, words: str | None = None) -> DataFrame:
    """Every row and column of ``docs`` with lang_pred and score (mean share of the winning label).

    Only the text is used. Null texts and texts without a letter are ``und`` with score 0, as are all
    texts where nothing could be learned. Ties go to the first language by name. Columns lang_pred
    and score of the input are replaced; an empty table stays empty. A column named by ``confidence`` is
    added with the mean share of each word's own best label, which a mixed text of plain words has too. A column named
    by ``words`` is added with every word, lower-cased and in order, and its label; it is empty where lang_pred is ``und``.
    Rows that repeat are labelled each.
    """
    added = ["lang_pred", "score", *([confidence] if confidence else []), *([words] if words else [])]
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    names, text_at = docs.columns, docs.columns.index("text")
    seen: dict[str, int] = {}
    scores = [np.zeros((0, max(1, len(crf.languages))), np.float32)]

    def of(batch: pa.RecordBatch):
        model = shared.value
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            if len(seen) > MAX_WORDS:
                seen.clear()
                scores[0] = scores[0][:0]
            numbers, fresh, spelled = [], [], []
            for text in part.column(text_at).to_pylist():
                found = words_of(text) if text else []
                if not model.languages or not has_letter(found):
                    found = []
                for w in set(found).difference(seen):
                    seen[w] = len(seen)
                    fresh.append(w)
                numbers.append(np.fromiter(map(seen.__getitem__, found), np.int32, len(found)))
                if words:
                    spelled.append(found)
            if fresh:
                scores[0] = np.concatenate([scores[0], np.exp(model.word_scores(fresh))])
            sure = np.zeros(part.num_rows) if confidence else None
            labels = [()] * part.num_rows if words else None
            shares = model.label_shares(numbers, scores[0], sure, labels) if model.languages else np.zeros((part.num_rows, 1))
            best = shares.argmax(axis=1)
            known = np.fromiter(map(len, numbers), np.int64, len(numbers)) > 0
            pred = [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(shares[np.arange(len(best)), best], 0, 1), 0.0)
            more = [pa.array(pred), pa.array(score), *([pa.array(np.clip(sure, 0, 1))] if confidence else [])]
            if words:
                each = [
                    [{"word": w, "lang": model.languages[y]} for w, y in zip(own, of_text, strict=True)] for own,
                    of_text in zip(spelled, labels, strict=True)
                ]
                more.append(pa.array(each, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*names, *added])

    schema = "lang_pred string, score double" + (f", `{confidence}` double" if confidence else "") + (
        f", `{words}` array<struct<word:string,lang:string>>" if words else ""
    )
    return map_rows(docs, of, extended(docs, schema))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents; edge cases as of ``predict``, those of the sample as of ``training_sample``."""
    docs = documents(spark, sf_dir)
    found = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
