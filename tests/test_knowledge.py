import json

import pytest
from pyspark.sql import functions as F

from quire import engine, plugins
from quire.functions.repair import repair_value
from quire.operators import annotations, extraction, files, graph, index, knowledge, pages, retrieval
from quire.sources import files as sources

ENTITY = "extraction string, ord long, name string, type string, properties map<string,string>, confidence double, source_text string, seq long"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ('noise {"a": "x", "b": ["y"', {"a": "x", "b": ["y"]}),
        ('{"a": "cut of', {"a": "cut of"}),
        ('{"a": 1, "b', {"a": 1}),
        ('{"e": [{"n": "x"}, {"n": ', {"e": [{"n": "x"}, {}]}),
        ('{"a": "q\\"x"}] tail', {"a": 'q"x'}),
        ("nothing", None),
        (None, None),
    ],
)
def test_repair(text, want):
    found = repair_value(text)
    assert (None if found is None else json.loads(found)) == want


def test_answers_without_a_reading_fall_back_on_rules(spark):
    docs = spark.createDataFrame([("p1", "see a.b@c.org"), ("p2", "see d.e@f.org"), ("p3", None)], "extraction string, text string")
    answers = spark.createDataFrame(
        [("p1", '{"entities": [{"name": "X", "type": "Bank"}], "relations": []}'), ("p2", "sorry")], "extraction string, answer string"
    )
    entities, relations = knowledge.extract(docs, answers)
    assert sorted((r.extraction, r.name, r.type) for r in entities.collect()) == [
        ("p1", "X", "Organization"), ("p1", "p1", "Document"), ("p2", "d.e", "Person"), ("p2", "p2", "Document"), ("p3", "p3", "Document")
    ]
    assert [(r.source, r.target, r.type) for r in relations.collect()] == [("p2", "d.e", "MENTIONS_PERSON")]
    assert knowledge.extract(docs.where("false"), answers.where("false"))[0].count() == 0


def test_import_is_idempotent_and_keeps_the_last_values(spark):
    rows = [
        ("x", 0, "A", "Person", {"role": "old", "name": "A"}, 0.5, "s", 1),
        ("x", 1, "A", "Person", {"role": "new", "email": None}, 0.9, None, 2), ("x", 2, "A", "Topic", {}, 0.9, "", 3),
        ("x", 3, None, "Topic", {}, 1.0, "", 4), ("x", 4, "doc", "Document", {"doc_id": "D"}, 1.0, "", 5)
    ]
    e = spark.createDataFrame(rows, ENTITY)
    r = spark.createDataFrame(
        [("x", 0, "doc", "A", "COVERS_TOPIC", 0.5, "", 1), ("x", 1, "doc", "ghost", "COVERS_TOPIC", 0.5, "", 2), ("x", 2, "doc", "A", None, 0.5, "", 3)],
        "extraction string, ord long, source string, target string, type string, confidence double, source_text string, seq long"
    )
    once = {(n.label, n.key): n.props for n in knowledge.imported_nodes(e).collect()}
    assert once[("Person", "A")] == {"name": "A", "role": "new", "_confidence": "0.9", "_source_text": "s", "_extraction_method": "llm"}
    assert set(once) == {("Person", "A"), ("Topic", "A"), ("Document", "D")}
    assert {(n.label, n.key): n.props for n in knowledge.imported_nodes(e.unionAll(e)).collect()} == once
    assert [(x.src_key, x.dst_label, x.dst_key) for x in knowledge.imported_edges(r, e).collect()] == [("D", "Topic", "A")]
    assert tuple(knowledge.import_statistics(r, e).first()) == (1, 4, 1, 1, 1)
    more = knowledge.with_document_metadata(
        e, spark.createDataFrame([("x", {"doc_id": "other", "tracker": "T"})], "extraction string, extra map<string,string>")
    )
    assert [x.properties for x in more.where("type = 'Document'").collect()] == [{"doc_id": "D", "tracker": "T"}]


def test_clearing_needs_a_word(spark):
    nodes = spark.createDataFrame([("A", "1")], "label string, key string")
    with pytest.raises(ValueError, match="confirm"):
        knowledge.cleared(nodes)
    assert knowledge.cleared(nodes, confirm=True).count() == 0
    assert knowledge.added_nodes(nodes, nodes).count() == 2


def test_tagged_extraction(spark):
    mentions = [
        ("Ada", "PERSON", "s1", 0, 0), ("ada", "PERSON", "s2", 9, 9), ("Acme Corp", "ORG", "s1", 2, 3), ("Paris", "GPE", "s1", 5, 5),
        ("x", "OTHER", "s1", 7, 7), ("1990", "DATE", "s1", 8, 8)
    ]
    tokens = [
        (0, "Ada", "nsubj", 1, "s1"), (1, "leads", "ROOT", 1, "s1"), (2, "Acme", "compound", 3, "s1"), (3, "Corp", "dobj", 1, "s1"),
        (4, "in", "prep", 3, "s1"), (5, "Paris", "pobj", 4, "s1"), (6, "with", "prep", 3, "s1"), (8, "1990", "pobj", 6, "s1")
    ]
    docs = spark.createDataFrame(
        [("d", mentions, tokens), ("e", [], [])],
        "extraction string, mentions array<struct<text:string,label:string,sentence:string,first:int,last:int>>, tokens "
        "array<struct<i:int,text:string,dep:string,head:int,sentence:string>>"
    )
    entities, relations = knowledge.tagged_extraction(docs)
    assert sorted((r.extraction, r.name, r.type) for r in entities.collect()) == [
        ("d", "1990", "Reference"), ("d", "Acme Corp", "Organization"), ("d", "Ada", "Person"), ("d", "Paris", "Location"),
        ("d", "d", "Document"), ("e", "e", "Document")
    ]
    found = {(r.source, r.type, r.target) for r in relations.collect()}
    assert {x for x in found if x[0] != "d"} == {("Ada", "RELATED_TO", "Acme Corp"), ("Acme Corp", "HAS_LOCATION", "Paris")}
    assert {x[1:] for x in found if x[0] == "d"} == {
        ("MENTIONS_PERSON", "Ada"), ("MENTIONS_ORG", "Acme Corp"), ("HAS_LOCATION", "Paris"), ("HAS_REFERENCE", "1990")
    }


def test_similar_names_equal_all_pairs(spark):
    import random

    from quire.functions.metrics import similarity_value

    rng = random.Random(5)
    names = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(60)] + [
        "widget alpha", "widget alphas", "widgetalpha", "", "", "aaaaaaaaaa", "aaaaaaaaaaa"
    ]
    table = [("T", f"{i:03}", n) for i, n in enumerate(names)]
    df = spark.createDataFrame(table, "label string, key string, norm string")
    want = {(a[1], b[1]) for i, a in enumerate(table) for b in table[i + 1 :] if a[2] and b[2] and similarity_value(a[2], b[2]) >= 0.85}
    assert {(r.a, r.b) for r in graph.similar_names(df).collect()} == want and len(want) > 5
    leader: dict[str, str] = {}
    for _, k, _ in table:
        if k not in leader:
            leader[k] = k
            for a, b in sorted(want):
                if a == k:
                    leader.setdefault(b, k)
    assert {r.key: r.leader for r in graph.fuzzy_groups(df).collect()} == leader


def test_canonicalize(spark):
    rows = [("P", "1", "Ann Lee"), ("P", "2", "ann lee."), ("P", "3", "Jonathan Smith"), ("P", "4", "Jonathon Smith"), ("Q", "5", "Ann Lee"), ("P", "6", None)]
    nodes = spark.createDataFrame(rows, "label string, key string, name string")
    edges = spark.createDataFrame(
        [("Q", "5", "R", "P", "2"), ("P", "1", "R", "P", "2"), ("P", "4", "R", "Q", "5")],
        "src_label string, src_key string, rel_type string, dst_label string, dst_key string"
    )
    plan, kept, moved = graph.canonicalize(nodes, edges)
    assert {(r.key, r.canon) for r in plan.collect()} == {("1", "2"), ("3", "4")}
    assert {(r.key, tuple(r.aliases or ())) for r in kept.collect()} == {("2", ("Ann Lee",)), ("4", ("Jonathan Smith",)), ("5", ()), ("6", ())}
    assert {tuple(r) for r in moved.collect()} == {("Q", "5", "R", "P", "2"), ("P", "4", "R", "Q", "5")}
    assert graph.canonicalize(nodes, edges, labels=["Q"])[0].count() == 0


def test_passages_in_documents(spark):
    docs = spark.createDataFrame(
        [(1, "the quick brown fox jumps"), (2, "xthe quick brown foxy"), (3, "quick  brown"), (4, None), (5, "ab")], "id long, text string"
    )
    asked = spark.createDataFrame([(1, "the quick brown fox"), (2, "k b"), (3, "quick brown"), (4, ""), (5, None), (6, "a")], "query_id long, text string")
    assert sorted(tuple(r) for r in retrieval.containing(docs, asked).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (6, 5)]


def test_hybrid_leaves_out_lists_that_fail(spark):
    def broken():
        raise OSError("down")

    one = spark.createDataFrame([(1, 1, "a")], "query_id long, rank int, id string")
    assert [r.id for r in retrieval.hybrid({"bm25": lambda: one, "vector": broken}).collect()] == ["a"]


def test_engine_answers(spark, tmp_path):
    chunks = spark.createDataFrame(
        [("c1", "red apples grow", "d1", 1), ("c2", "blue whales swim", "d2", 1), ("c3", None, "d2", 2)],
        "chunk_id string, text string, document_id string, page_number int"
    )
    vectors = plugins.embed(chunks.select(F.col("chunk_id").alias("id"), "text"), lambda texts: [[float("whales" in t), 1.0] for t in texts])
    folder = f"file://{tmp_path}/index"
    assert index.build_index(chunks, folder, vectors) and not index.build_index(chunks, folder)
    asked = spark.createDataFrame([(1, "where do whales swim"), (2, "zebra")], "query_id long, text string")
    config = sources.read_config(f"index:\n  folder: {folder}\nretrieval:  # lists\n  top_k: 5\n  final_top_k: 2\n")
    embedded = lambda q: q.select("query_id", F.array(F.contains("text", F.lit("whales")).cast("double"), F.lit(1.0)).alias("v"))
    e = engine.Engine.from_config(spark, config, embedded=embedded, generator=lambda p: iter(["to ", p[-6:]]))
    found = e.retrieve(asked)
    assert e.k == 2 and found.where("query_id = 1 and rank = 1").first().id == "c2"
    history = spark.createDataFrame([(1, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    answers = {r.query_id: r for r in e.answer(asked, history).collect()}
    assert answers[1].answer == "to s swim" and "User: hi" in answers[1].prompt and "[d2] blue whales swim" in answers[1].prompt
    assert [x["event"] for x in e.stream("whales")] == ["token", "token", "done"]
    index.reset_vectors(spark, folder)
    assert index.load_index(spark, folder)["vectors"].count() == 0


def test_answers_stream_and_fall_back():
    def broken(prompt):
        raise OSError
        yield

    events = list(plugins.stream_answer("p", broken, whole=lambda p: p + "!"))
    assert events == [{"event": "token", "data": "p!"}, {"event": "done", "data": "p!"}]
    providers = plugins.Providers({"a": lambda p: ["A"], "b": lambda p: ["B"]}, "a")
    providers.switch("b")
    assert list(providers("x")) == ["B"]
    with pytest.raises(KeyError):
        providers.switch("c")


def test_retry_waits_as_told():
    waited = []

    class Busy(Exception):
        retry_after = 7

    def call(done=[]):
        done.append(1)
        if len(done) < 2:
            raise Busy
        return "ok"

    assert plugins.retry(call, wait=waited.append)() == "ok" and waited == [7.0]


def test_files_are_read_routed_and_recognised(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"x" * 400)
    (tmp_path / "scan.pdf").write_bytes(b"y")
    (tmp_path / "bad.pdf").write_bytes(b"!")

    def parse(content):
        if content == b"!":
            raise ValueError("broken")
        return [{"page_number": n, "text": content.decode(), "tables": [[[None]], [["a"]]], "width": 100.0, "height": 100.0} for n in (2, 1)]

    parsed = sources.native_pages(sources.parse_documents(sources.binary_files(spark, str(tmp_path)), parse))
    assert {(r.char_count, r.coverage, len(r.tables)) for r in parsed.where("error is null").collect()} == {(400, 0.8, 1), (1, 0.002, 1)}
    found = {
        r.document_id.rsplit("/", 1)[1]: r for r in engine.process_files(
            sources.binary_files(spark, str(tmp_path)), parse, recognise=lambda image: "seen"
        ).collect()
    }
    assert (found["good.pdf"].method, found["good.pdf"].plan) == ("native", "skipped_due_to_high_native_coverage")
    assert (found["scan.pdf"].method, found["scan.pdf"].text) == ("ocr", "seen") and found["bad.pdf"].error == "broken"
    counted = sources.page_counts(sources.binary_files(spark, str(tmp_path)), lambda c: 3 if c != b"!" else int("x"))
    assert sorted((r.total_pages or 0, r.error is None) for r in counted.collect()) == [(0, False), (3, True), (3, True)]
    images = sources.page_images(
        sources.binary_files(spark, str(tmp_path), "good.pdf").join(counted.select("path", "total_pages"), "path"), lambda c,
        n: b"png%d" % n, first=2
    )
    assert [
        (r.image_name, bytes(r.image)) for r in images.orderBy("page_number").collect()
    ] == [("good_page_0002.png", b"png2"), ("good_page_0003.png", b"png3")]
    assert images.select(pages.encoded_image("image").alias("b")).first().b in ("cG5nMg==", "cG5nMw==")


def test_graph_from_pages_resumes(spark):
    docs = spark.createDataFrame(
        [("p1", "a.b@c.org", "f1"), ("p2", "d.e@f.org", "f2"), ("p3", "x.y@z.org", "f3")], "extraction string, text string, file string"
    )
    done = spark.createDataFrame([("f1", "completed"), ("f2", "failed")], "file_name string, state string")
    made = engine.build_graph(docs, engine.both(engine.by_rules, engine.by_rules), done)
    assert {r.key for r in made["nodes"].where("label = 'Person'").collect()} == {"d.e", "x.y"} and made["edges"].count() == 2
    parts = [engine.build_graph(docs, engine.by_rules, share=(i, 2))["nodes"].count() for i in (0, 1)]
    assert sum(parts) == 6


def test_predictions_and_benchmark(spark):
    p = spark.createDataFrame([("d", 1, "hello"), ("d", 2, "alone")], "document_id string, page_number int, text string")
    t = spark.createDataFrame([("d", 1, "hallo")], "document_id string, page_number int, text string")
    row = pages.evaluate_predictions(p, t).collect()
    assert [(r.cer, r.wer, r.similarity, r.truth_words) for r in row] == [(0.2, 1.0, 0.8, 1)]
    runs = spark.createDataFrame(
        [("m", "d", 4, 2.0, 1.0, "hello", []), ("m", "e", 1, 0.0, 1.0, "x", ["e"])],
        "method string, document_id string, total_pages int, processing_time double, memory_peak double, text string, errors array<string>"
    )
    found = {r.document_id: r for r in pages.extraction_benchmark(runs, spark.createDataFrame([("d", "hallo")], "document_id string, truth string")).collect()}
    assert (found["d"].cer, found["d"].pages_per_second, found["e"].cer, found["e"].pages_per_second, found["e"].n_errors) == (0.2, 2.0, None, 0.0, 1)
    images = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("e", 1, None)], "document_id string, page_number int, text string")
    assert sorted((r.document_id, r.text, r.error) for r in pages.whole_recognition(images).collect()) == [("d", "a\n\nb", None), ("e", "", "no images")]


def test_replacement_runs_until_enough_succeed(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "file_name string")
    run = lambda df: df.withColumn("state", F.when(F.col("file_name") < "c", "failed").otherwise("processed"))
    done = files.run_with_replacement(names("a", "d"), names("b", "e", "f", "g"), run, 3)
    assert {r.file_name for r in done.where("state = 'processed'").collect()} == {"d", "e", "f"} and done.count() == 5


def test_annotation_files_and_configuration(spark, tmp_path):
    (tmp_path / "store.json").write_text(json.dumps({"a_1": {"pdf_path": "a", "page_number": 1}, "b_2": {"pdf_path": "b", "page_number": 2}}))
    found = sources.annotations(spark, str(tmp_path / "store.json"), "pdf_path STRING, page_number INT").collect()
    assert sorted((r.key, r.pdf_path, r.page_number) for r in found) == [("a_1", "a", 1), ("b_2", "b", 2)]
    text = "# c\na:\n  b: ${X:-1.5}\n  c: 'x # y'\nlist:\n- p\n- 2\nempty:\nflag: true\n"
    assert sources.read_config(text, {}) == {"a": {"b": 1.5, "c": "x # y"}, "list": ["p", 2], "empty": None, "flag": True}


def test_extraction_files_to_rows(spark, tmp_path):
    one = {"source_document": "d", "entities": [{"name": "n", "type": "City"}], "relations": [{"source": "d", "target": "n", "type": "MENTIONS"}]}
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps([one, one]))
    found = sources.extractions(spark, f"{tmp_path}/*.json")
    entities, relations = sources.extraction_rows(found)
    assert entities.count() == relations.count() == 3 and entities.first().confidence == 1.0
    assert sorted((r.extractions, r.entities, r.relations) for r in sources.extraction_statistics(found).collect()) == [(1, 1, 1), (2, 2, 2)]
    assert knowledge.imported_nodes(entities).count() == 1


def test_processed_results_in_any_layout(spark, tmp_path):
    for where in ("batch1/results", "batch2/GS/results", "flat"):
        (tmp_path / where).mkdir(parents=True)
        (tmp_path / where / "x_results.json").write_text(json.dumps({"source_pdf": "x", "pages": []}))
    assert {(r.stem, r.source_dir) for r in sources.processed_results(spark, str(tmp_path)).collect()} == {("x", "batch1"), ("x", "GS"), ("x", "flat")}


def test_document_summary_and_lists(spark, tmp_path):
    rows = spark.createDataFrame(
        [("d", 2, True, None, 0.5), ("d", 1, False, True, 0.1)],
        "document_id string, page_number int, native_ok boolean, ocr_ok boolean, coverage double"
    )
    r = extraction.document_summary(rows).first()
    assert (r.native_success_rate, r.native_failed_pages, r.ocr_failed_pages, round(r.average_native_coverage, 3)) == ("1/2", [1], [2], 0.3)
    paths = spark.createDataFrame([("b",), ("a",)], "path string")
    sources.write_list(paths, str(tmp_path / "list"))
    assert [x.path for x in sources.file_list(spark, str(tmp_path / "list")).collect()] == ["a", "b"]
    sources.write_report(rows.agg(F.count("*").alias("n")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().n == 2


def test_missing_items_need_all_parts(spark):
    df = spark.createDataFrame([("a | b | c\n|x|y\nonly\r\n d|e|f|g ",), (None,)], "t string").select(
        annotations.missing_items("t", ["source", "target", "relation_type"]).alias("m")
    )
    assert [[tuple(x) for x in r.m] for r in df.collect()] == [[("a", "b", "c"), ("d", "e", "f")], []]


def test_commands(spark, tmp_path):
    from quire.__main__ import main

    run = lambda *a: [json.loads(x) for x in main([str(x) for x in a], spark)]
    for stem, text in (("a", "red apples and green pears " * 4), ("b", "blue whales swim in the sea " * 4)):
        (tmp_path / "in").mkdir(exist_ok=True)
        page = {"page_number": 1, "native": {"text": text, "success": True}, "ocr": {"text": ""}}
        (tmp_path / "in" / f"{stem}_results.json").write_text(json.dumps({"source_pdf": stem, "total_pages": 1, "pages": [page]}))
    assert run("ingest", tmp_path / "in", "--to", tmp_path / "pages") == [{"files": 2}]
    built = run("index", tmp_path / "in", "--to", tmp_path / "index")[0]
    assert (built["documents"], built["built"]) == (2, True)
    assert run("index", tmp_path / "in", "--to", tmp_path / "index")[0]["built"] is False
    assert run("stats", "--index", tmp_path / "index")[0]["chunks"] == built["chunks"]
    assert run("query", "whales", "--index", tmp_path / "index")[0]["id"].startswith("b_page_1")
    one = {"source_document": "d", "entities": [{"name": n, "type": "Person"} for n in ("Ann Lee", "ann lee")] + [{"name": "d", "type": "Document"}], "relations": [{"source": "d", "target": "Ann Lee", "type": "MENTIONS_PERSON"}]}
    (tmp_path / "x.json").write_text(json.dumps(one))
    assert run("graph-import", tmp_path / "x.json", "--to", tmp_path / "graph")[0]["entities_created"] == 3
    assert {(x["name"], x["n"]) for x in run("graph-stats", tmp_path / "graph")} == {("Person", 2), ("Document", 1), ("MENTIONS_PERSON", 1)}
    assert run("graph-integrity", tmp_path / "graph")[0]["orphan_nodes"] == 1
    assert [x["key"] for x in run("graph-canonicalize", tmp_path / "graph", "--dry-run")] == ["ann lee"]
    assert len(run("graph-canonicalize", tmp_path / "graph", "--to", tmp_path / "merged")) == 1 and spark.read.parquet(str(tmp_path / "merged/nodes")).count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "p.txt").write_text("mail a.b@c.org")
    assert run("graph-extract", tmp_path / "t", "--to", tmp_path / "g2")[0]["entities_created"] == 2
    assert run("evaluate", tmp_path / "t", tmp_path / "t")[0]["cer"] == 0
    (tmp_path / "store.json").write_text(json.dumps({"k": {"document_id": "d", "page_number": 1, "entity_annotations": [{"entity_type": "Person", "judgment": "correct"}]}}))
    assert run("entity-report", tmp_path / "store.json")[0]["mean_entity_f1"] == 1.0
    with pytest.raises(SystemExit):
        main(["graph-canonicalize", str(tmp_path / "graph")], spark)
