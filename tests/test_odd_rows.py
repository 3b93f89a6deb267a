"""Queries against their SQL over rows that the test tables lack, and steps whose work must not grow with copies."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import connect, rows

from quire.operators import knowledge as operators
from quire.plans import catalogue, knowledge, stores  # noqa: F401
from quire.plans.registry import ORACLES, QUERIES

TEXTS = ["", "plain text", "G " * 150, " " * 250, "g" * 199, "　" * 300 + "ab", None, "é" * 120 + "abcdefghij" * 8, "\U0001f600" * 90 + "ab" * 60, "\x1c\x85" * 150]


@pytest.mark.parametrize("name", ["text_pick", "document_export", "garbage_pages"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    texts = TEXTS * 6
    table = {
        "doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "source": [f"src{i % 5}" for i in range(len(texts))],
        "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())
    }
    pq.write_table(pa.table(table), f"{tmp_path}/documents.parquet")
    found = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert rows(found) == rows(connect(tmp_path).execute(ORACLES[name]).fetchdf())


def test_answers_are_read_once(spark):
    answers = spark.createDataFrame([("a", '{"entities": [{"name": "X", "type": "Bank"}], "relations": []}'), ("b", "{")], "extraction string, answer string")
    parsed = operators.read_answers(answers)
    relations = operators.answer_relations(parsed, operators.answer_entities(parsed))
    assert "from_json" not in relations._jdf.queryExecution().optimizedPlan().toString()
    assert {r.extraction: r.parsed is None for r in parsed.collect()} == {"a": False, "b": False}


def test_equal_names_meet_only_once(spark, monkeypatch):
    from quire.operators import graph

    seen = []
    whole = graph.similar_names
    monkeypatch.setattr(graph, "similar_names", lambda names, threshold: seen.append(names.count()) or whole(names, threshold))
    table = [("T", f"{i:03}", n) for i, n in enumerate(["widget alphas", "widget alpha", "other thing", "", None, "widget alphaes"] * 20)]
    found = {r.key: r.leader for r in graph.fuzzy_groups(spark.createDataFrame(table, "label string, key string, norm string")).collect()}
    assert seen == [4]
    assert found == {k: {"o": "002", "w": "000"}[n[0]] if n else k for _, k, n in table}


def test_bm25_of_tasks_equals_plain_python(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from quire.operators import index, retrieval

    monkeypatch.setattr(retrieval, "MOST_HITS", 40)
    monkeypatch.setattr(retrieval, "MOST_ASKED", 7)
    rng = random.Random(3)
    texts = [None, "", *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(150))]
    texts += texts[50:90]  # ties
    asked = {q: " ".join(rng.choice("abcdxyz") for _ in range(5)) for q in ("p", "q", "r", "s")}
    chunks = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "id string, text string").repartition(5)
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    words = [(t or "").split() for t in texts]
    mean = sum(map(len, words)) / len(words)
    df = Counter(w for x in words for w in set(x))
    want = {}
    for q, text in asked.items():
        idf = {w: math.log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in text.split()}
        scores = [(round(sum(idf[w] * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for w in text.split()), 6), i) for i, x in enumerate(words)]
        for r, (score, i) in enumerate(sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1]))[:10], 1):
            want[q, r] = f"{i:03}", score
    found = retrieval.bm25(chunks, queries)
    assert {(r.query_id, r.rank): (r.id, r.score) for r in found.collect()} == want
    plan = retrieval.word_counts(chunks, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    posted = index.index_postings(chunks.withColumnRenamed("id", "chunk_id"))
    assert posted.where("term = ''").count() == len(texts) and "hashpartitioning" not in posted._jdf.queryExecution().executedPlan().toString()
    by_index = index.search_index({"postings": posted}, queries)
    assert {(r.query_id, r.rank): (r.id, r.score) for r in by_index.collect()} == want
    assert retrieval.bm25(chunks.where("false"), queries).count() == retrieval.bm25(chunks, queries.where("false")).count() == 0


def test_nearest_vectors_with_many_ties(spark):
    import numpy as np

    from quire.operators import retrieval

    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 4))
    vectors = {i: base[i % 30 if i < 300 else 0].tolist() for i in range(900)}
    df = spark.createDataFrame([*vectors.items(), (900, None)], "id long, v array<float>")
    found = retrieval.cosine_top_k(df, df.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 7)
    x = np.array(list(vectors.values()), np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in range(0, 900, 50):
        s = np.round(x @ x[q], 6)
        want |= {(q, r, i) for r, i in enumerate([i for i in np.lexsort((range(900), -s)).tolist() if i != q][:7], 1)}
    assert {(r.query_id, r.rank, r.id) for r in found.collect()} == want


def test_edits_are_those_of_difflib(monkeypatch):
    import difflib
    import random
    import time

    from quire.functions import metrics

    def wanted(a, b):
        return sum(0 if tag == "equal" else max(a1 - a0, b1 - b0) for tag, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b).get_opcodes())

    rng = random.Random(1)
    for length, letters in [(0, "a"), (9, "ab"), (30, "ab"), (199, "abcdef"), (200, "abcdef"), (700, "".join(map(chr, range(97, 197)))), (900, "aaaaaaaaabcdefghijklmnopqrst")] * 12:
        a = "".join(rng.choice(letters) for _ in range(length))
        b = "".join(c for c in a if rng.random() > 0.1) + rng.choice(["", a[:50]])
        for x, y in ((a, b), (b, a), (a.split("a"), b.split("a"))):
            for most in (64, 2, 0):
                monkeypatch.setattr(metrics, "MOST_LEVELS", most)
                assert metrics._edits(x, y) == wanted(x, y)
    monkeypatch.undo()
    text = "".join(rng.choice(letters + "0123456789" * 3) for _ in range(20_000))
    noisy = "".join("#" if i % 17 == 16 else c for i, c in enumerate(text))
    began = time.process_time()
    want, plain = wanted(text, noisy), time.process_time() - began
    began = time.process_time()
    assert metrics._edits(text, noisy) == want and time.process_time() - began < plain
    began = time.process_time()
    assert metrics.cer_value(text, text) == 0 and time.process_time() - began < plain / 10


def test_steps_start_at_reached_nodes_only(spark, monkeypatch):
    from quire.operators import graph

    rows = [("D", "1", "r", "P", "x"), ("D", "1", "r", "P", "x"), ("P", "x", "r", "P", "x"), ("P", "y", "s", "P", "x"), ("D", "2", "r", "P", "y"), (None, "1", "r", "P", "x")]
    edges = spark.createDataFrame(rows, "src_label string, src_key string, rel_type string, dst_label string, dst_key string")
    at = graph.durable(spark.createDataFrame([("P", "x")], "label string, key string"), "at")
    want = sorted(map(repr, graph._steps(edges).where("a_label = 'P' and a_key = 'x'").collect()))
    for most in (10, 0):
        monkeypatch.setattr(graph, "MOST_BROADCAST", most)
        assert sorted(map(repr, graph._steps_from(edges, at).collect())) == want
    monkeypatch.undo()
    plan = graph._steps_from(edges.distinct(), at)._jdf.queryExecution().optimizedPlan().toString()
    assert all("Join LeftSemi" in part.split("Aggregate")[1] for part in plan.split("Project [xxhash64")[1:])


def test_only_labels_with_duplicates_are_joined(spark, monkeypatch):
    from quire.operators import graph

    rows = [("D", "1", "r", "P", "b"), ("D", "1", "r", "P", "a"), ("D", "1", "r", "T", "b"), ("P", "b", "s", "P", "a"), (None, "b", "r", "P", "b"), ("P", None, "r", "D", "1")]
    edges = spark.createDataFrame(rows * 2, "src_label string, src_key string, rel_type string, dst_label string, dst_key string")
    picked = spark.createDataFrame([("P", "a", "a"), ("P", "b", "a")], "label string, key string, canon string")
    want = {("D", "1", "r", "P", "a"), ("D", "1", "r", "T", "b"), (None, "b", "r", "P", "a"), ("P", None, "r", "D", "1")}
    for most in (1000, 0):
        monkeypatch.setattr(graph, "MOST_LABELS", most)
        found = [tuple(r) for r in graph.repoint(edges, picked).collect()]
        assert len(found) == len(want) and set(found) == want
    assert graph.repoint(edges, picked.where("false")).count() == 6
