import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import metrics
from quire.functions import text as T
from quire.functions.splitter import split_text
from quire.operators import evaluation, extraction, files, graph, retrieval
from quire.plugins import retry
from quire.sources import files as sources
from quire.streaming.ingest import ingest_results


def test_metric_examples():
    assert metrics.cer_value("hello", "hallo") == 0.2
    assert metrics.wer_value("hello", "hallo") == 1.0
    assert metrics.similarity_value("hello", "hallo") == 0.8
    assert metrics.wer_value("the quick brown fox", "the fast brown fox") == 0.25
    for f, both, one in ((metrics.cer_value, 0, 1), (metrics.wer_value, 0, 1), (metrics.similarity_value, 1, 0)):
        assert (f("", ""), f("", "something"), f("something", "")) == (both, one, one)


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs_equals_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert metrics.lcs_length(a, b) == t[-1][-1]


def test_splitter_windows():
    assert split_text("short") == ["short"]
    text = "".join(chr(97 + i % 26) for i in range(1700))
    assert split_text(text) == [text[0:800], text[650:1450], text[1300:1700]]
    assert all(len(c) <= 800 for c in split_text("word " * 900 + "\n\n" + "x" * 900))


def test_text_expressions(spark):
    df = spark.createDataFrame([("  A b\x1cc ", "G " * 150, "Foo-Bar!  baz")], "a string, g string, n string")
    row = df.select(
        T.tokens("a").alias("t"), T.word_count("a").alias("w"), T.is_garbage("g").alias("g"), T.is_garbage("n").alias("h"),
        T.normalize_name("n").alias("n"), T.document_of_chunk(F.lit(None).cast("string"), F.lit("d_chunk_1_chunk_2")).alias("d")
    ).first()
    assert (row.t, row.w, row.g, row.h, row.n, row.d) == (["a", "b", "c"], 3, True, False, "foo bar baz", "d_chunk_1")


def test_routing(spark):
    rows = [(True, 0.9, True), (True, 0.1, True), (True, 0.1, False), (False, 0.0, False)]
    df = spark.createDataFrame(rows, "n boolean, c double, o boolean").select(extraction.route(F.col("n"), F.col("c"), F.col("o")).alias("r"))
    assert [r.r for r in df.collect()] == ["native", "ocr", "native_fallback", "failed"]


def test_rule_entities_share_seen_values(spark):
    text = "mail a.b@c.org and a.b@c.org, PO# AB1234 then Invoice AB1234 and Contract ID: XY-99"
    found = extraction.rule_entities(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("ord").collect()
    assert [(r.type, r.name, r.kind) for r in found] == [
        ("Document", "d", "document"), ("Person", "a.b", "email"), ("Reference", "AB1234", "purchase_order"),
        ("Reference", "XY-99", "contract")
    ]


def test_merge_is_idempotent(spark):
    rows = spark.createDataFrame(
        [("P", "1", 1, "x", None), ("P", "1", 2, None, "y"), ("P", "1", 3, "z", None)],
        "label string, key string, seq int, a string, b string"
    )
    once = graph.merge_nodes(rows, ["a", "b"]).collect()
    assert [(r.a, r.b) for r in once] == [("z", "y")]
    assert graph.merge_nodes(rows.unionAll(rows), ["a", "b"]).collect() == once


def test_fusion_ignores_list_order_but_for_source(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id int, rank int, id int")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "query_id int, rank int, id int")
    x = retrieval.fuse({"a": a, "b": b}).select("id", "score").collect()
    assert x == retrieval.fuse({"b": b, "a": a}).select("id", "score").collect()
    assert x[0].id == 11


def test_fuzzy_leaders(spark):
    rows = [("T", "1", "widget alpha"), ("T", "2", "widget alphas"), ("T", "3", "other thing")]
    found = graph.fuzzy_groups(spark.createDataFrame(rows, "label string, key string, norm string")).collect()
    assert {(r.key, r.leader) for r in found} == {("1", "1"), ("2", "1"), ("3", "3")}


def test_page_scores_empty_recall(spark):
    judged = spark.createDataFrame([("p", "wrong", False)], "page string, judgment string, hallucinated boolean")
    row = evaluation.page_scores(judged, spark.createDataFrame([], "page string, n_missing long")).first()
    assert (row.precision, row.recall, row.f1) == (0, 0, 0)


def test_upsert_keeps_latest(spark):
    a, b = (spark.createDataFrame([(1, t, v)], "k int, ts int, v string") for t, v in ((1, "old"), (2, "new")))
    assert [r.v for r in files.upsert(a, b, ["k"], "ts").collect()] == ["new"]


def _result(name):
    return {
        "source_pdf": name, "total_pages": 1,
        "pages": [{"page_number": 1, "native": {"text": "t", "tables": [[["a", None]], [[None]]], "success": True}, "ocr": {"text": "o"}}]
    }


def test_sources_and_resumable_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a_results.json").write_text(json.dumps(_result("a")))
    (src / "bad_results.json").write_text("{")
    docs = sources.result_documents(spark, f"{src}/*.json")
    assert [r.stem for r in docs.collect()] == ["a"]
    assert sources.combined_text(docs).first().text == "t"
    assert sources.corrupt_documents(spark, f"{src}/*.json").count() == 1
    to = (str(src), str(tmp_path / "pages"), str(tmp_path / "check"))
    ingest_results(spark, *to)
    assert spark.read.parquet(to[1]).count() == 1
    (src / "b_results.json").write_text(json.dumps(_result("b")))
    ingest_results(spark, *to)
    ingest_results(spark, *to)
    assert spark.read.parquet(to[1]).count() == 2


def test_extraction_files_of_every_shape(spark, tmp_path):
    one = {"source_document": "d", "entities": [{"name": "n", "type": "City"}], "relations": []}
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps([one, one]))
    (tmp_path / "c.json").write_text(json.dumps({"extractions": [one, one, one]}))
    assert sources.extractions(spark, f"{tmp_path}/*.json").count() == 6


def test_parser_errors_are_rows(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"ok")
    (tmp_path / "y.pdf").write_bytes(b"no")

    def parse(content):
        if content == b"no":
            raise ValueError("broken")
        return [{"page_number": 1, "text": content.decode(), "coverage": 1.0}]

    found = sources.parse_documents(sources.binary_files(spark, str(tmp_path)), parse).collect()
    assert sorted((r.text or "", r.error or "") for r in found) == [("", "broken"), ("ok", "")]


def test_environment_and_retry():
    assert sources.expand_env("${A}-${B:-x}-${C}", {"A": "1"}) == "1-x-"
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert retry(flaky, wait=lambda s: None)() == "done"
    with pytest.raises(KeyError):
        retry(lambda: {}["x"], fatal=(KeyError,), wait=lambda s: None)()


def test_queries_without_sql_equal_plain_python(spark):
    import re

    from compare import DATA

    from quire.plans import catalogue  # noqa: F401
    from quire.plans.registry import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {(int(r.document_id), r.chunk_index): r.text for r in QUERIES["chunk_split"](spark, DATA).collect()}
    want = {(d, i): c for d, t in texts.items() if len(t.strip()) >= 50 for i, c in enumerate(split_text(t)) if len(c.strip()) >= 50}
    assert found == want
    noisy = {d: re.sub("(.{16}).", r"\1#", t, flags=re.S) for d, t in texts.items()}
    for r in QUERIES["cer_wer_similarity"](spark, DATA).limit(40).collect():
        pair = noisy[r.doc_id], texts[r.doc_id]
        assert (r.cer, r.wer, r.similarity) == pytest.approx((metrics.cer_value(*pair), metrics.wer_value(*pair), metrics.similarity_value(*pair)), abs=1e-6)
