"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from compare import DATA, connect, rows
from pyspark.sql import functions as F

from quire.llm import bitslice, decontaminate, hosts, huffman, langid, lines, near, ngram_lm, packing, secret_scan, simhash
from quire.llm.components import connected_components
from quire.llm.queries import ORACLES, QUERIES
from quire.llm.tokens import WordEncoder, encode_texts, tokenizer_path

EDGE = [
    (1, "Alpha beta gamma delta\nA line of text that repeats\npassword = 'abcdef123'", "en", "extra"),
    (2, "a line of TEXT that repeats  \n\nx", "en", None),
    (3, None, None, None),
    (4, "", "fr", "z"),
    (5, "word " * 5000, None, "z"),
    (6, "word " * 5000, "de", "z"),
    (7, "éß 日本 \x1c\x85 <|endoftext|> tab\there  two", "es", "z"),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, equal texts and columns whose names clash with those that operators add."""
    return spark.createDataFrame(
        EDGE, "doc_id long, text string, lang string, key string"
    ).withColumn("n_words", F.lit("mine")).withColumn("score", F.lit("mine")).withColumn("kept_text", F.lit("mine"))


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


def items(spark, rows_):
    return spark.createDataFrame(rows_, "item_id long, text string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    found, wanted = QUERIES[name](spark, DATA).toPandas(), connect().execute(ORACLES[name]).fetchdf()
    assert rows(found) == rows(wanted)


def test_bit_slices_equal_products(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", 40)
    monkeypatch.setattr(bitslice, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    vectors = {i: rng.integers(-3, 4, 5).tolist() for i in range(150)}
    vectors[60] = [1000000, -1000000, 0, 7, 7]
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, q array<int>")
    found = bitslice.top_k(df, df.where("vec_id % 10 = 0"), 20).collect()
    for q in range(0, 150, 10):
        scored = sorted((-int(np.dot(np.array(vectors[q], object), np.array(v, object))), i) for i, v in vectors.items() if i != q)[:20]
        assert sorted((r.rank, r.vec_id, -r.score) for r in found if r.query_id == q) == [(n, i, s) for n, (s, i) in enumerate(scored, 1)]


def test_bit_slices_edge_cases(spark):
    bad = [(1, None), (2, []), (3, [float("nan")]), (4, [None]), (5, [float("inf")]), (None, [1.0]), (6, [0.5]), (7, [0.5, -1.0]), (7, [0.5, -1.0])]
    q = bitslice.quantise(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    assert sorted(r.vec_id for r in q.collect()) == [2, 6, 7, 7]
    found = bitslice.top_k(q.withColumn("number", F.lit("mine")), q.where("vec_id = 6")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(7, 1024), (7, 1024), (2, 0)]
    two = q.where("vec_id = 6").unionAll(q.where("vec_id = 7").selectExpr("6L", "q"))
    assert sorted((r.rank, r.vec_id) for r in bitslice.top_k(q, two).collect()) == [(1, 7), (1, 7), (2, 7), (2, 7), (3, 2), (3, 2)]
    assert bitslice.top_k(q.where("false"), q).count() == 0 and bitslice.top_k(q, q.where("false")).count() == 0


def test_bit_slices_of_wide_components_are_exact(spark):
    vectors = {1: [1.0, 1.0], 2: [2e7, 1.0], 3: [3e7, -2.0], 4: [9e7, 0.0], 5: [1e9, 1e9], 6: [-1e9, 5.0], 7: [3e4, -3e4]}
    q = bitslice.quantise(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"))
    for asked in (1, 7):
        want = sorted((-sum(64 * int(a) * 64 * int(b) for a, b in zip(vectors[asked], v, strict=True)), i) for i, v in vectors.items() if i != asked)
        found = bitslice.top_k(q, q.where(f"vec_id = {asked}")).collect()
        assert sorted((-r.score, r.vec_id) for r in found) == want and sorted(r.rank for r in found) == [1, 2, 3, 4, 5, 6]
    huge = spark.createDataFrame([(1, [1e17]), (2, [1e17])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="component too large"):
        bitslice.quantise(huge).collect()
    with pytest.raises(Exception, match="too large|too big|Overflow"):
        wide = bitslice.quantise(spark.createDataFrame([(1, [5e15]), (2, [5e15])], "vec_id long, embedding array<double>"))
        bitslice.top_k(wide, wide).collect()


@pytest.mark.parametrize("counts", [[5], [1, 1], [0, 3, 0, 1], [2**i for i in range(40)], list(range(1, 400))])
def test_huffman_codes(counts):
    counts = np.array(counts, np.int64)
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.MAX_LENGTH and ((lengths > 0) == (counts > 0)).all()
    assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    book, rng = huffman.CodeBook(lengths), np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = rng.choice(np.flatnonzero(counts), n)
        assert (book.decode(n, *book.encode(ids)) == ids).all()


def test_ranges_of_sorted_bounds(spark):
    bounds = [float(b) for b in sorted({random.Random(n).randrange(-500, 500) for n in range(90)})]
    for some in (bounds, bounds[:1], bounds[:7], []):
        found = spark.range(-600, 600).select("id", huffman._range_of(F.col("id"), some).alias("r")).collect()
        assert all(r.r == sum(b <= r.id for b in some) for r in found)


def test_huffman_is_optimal_without_a_tight_limit():
    import heapq

    counts = [3, 1, 4, 1, 5, 9, 2, 6]
    heap, cost = counts[:], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (huffman.code_lengths(np.array(counts)) * np.array(counts)).sum() == cost


def test_token_files_round_trip(spark, edge, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    huffman.write_ids(edge, f"file://{tmp_path}/ids")
    found = {r.doc_id: r for r in huffman.read_ids(spark, f"file://{tmp_path}/ids").collect()}
    at = 0
    for doc_id, text, *_ in EDGE:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = found[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    some = spark.createDataFrame([(None, "b"), (None, None), (2, "two"), (2, "two"), (-3, "neg")], "doc_id long, text string").repartition(3)
    huffman.write_ids(some, f"file://{tmp_path}/some")
    found = huffman.read_ids(spark, f"file://{tmp_path}/some").orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, -3, 2, 2] and [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    huffman.write_ids(empty, f"file://{tmp_path}/none")
    assert huffman.read_ids(spark, f"file://{tmp_path}/none").count() == 0


def test_word_table_equals_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = [
        "", "\n", "a", " a", "a ", "a  b", "a\n\nb", "\nabc", "abc\n", "it's we'll don't.", "x, y. z.,", "é b", "a\tb", "x\x01y", "1 2³ 4½",
        "a_b-c", "日本 語"
    ]
    for text, raw in zip(texts, encode_texts(texts, tokenizer_path(), group=3, max_words=4), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_of_words_equal_library():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(tokenizer_path()), random.Random(8)
    parts = [
        *" \n'.,;:!?()[]{}<>|\"_-/@#~`^$%&*+=\\", *"aZ019éßÿſŉÀ×÷ªºµ¡¿²³¼«»§", "the", "'s", "'re", "'LL", "word,", "(x)", "2.5e3", "http://a.b/c?d=1",
        " of", " in", "\nAnd", ", ", ". ", "été", "\u00a0", "\u00ad", "\t", "日本"
    ]
    plain = parts[: parts.index("\u00a0")]
    texts = ["".join(rng.choice(parts if n % 9 == 0 else plain) for _ in range(rng.randrange(1, 30))) for n in range(4000)]
    for group in (50, 5000):
        for text, raw in zip(texts, encode_texts(texts, tokenizer_path(), group=group, max_words=300), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_the_library_encodes_a_word_once_whatever_marks_are_around_it():
    encoder = WordEncoder(tokenizer_path())
    words = ["".join(random.Random(n).choices("abdefghiklmnoprstu", k=9)) for n in range(400)]
    shapes = ["x {}", "x {},", "x {}.", "x {};", "x {}!", "x {}:", "x {}...", "x {}/{}", "x {}-{}", "x {}).", "x {}7"]
    texts = [shape.format(w, w) for shape in shapes for w in words]
    ids = encoder.encode(texts)
    assert len(encoder.known) <= 2 * len(words) + 20  # with a space before it, and without one after a mark
    assert ids == [np.array(encoder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_secrets_brute_force(spark):
    rng, parts = random.Random(5), [
        "password: abcdef9", "secret:token:abcdefgh", "AKIA" + "Z" * 16, "AKIAXX", "user=bob", "https://api.example.com/x", "f" * 24, "é ",
        "0" * 40, "token=ab", " and ", "\n", "x" * 190
    ]
    texts = ["".join(rng.choice(parts) for _ in range(25)) for _ in range(60)] + [None, "", "a" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.ord, s.kind, s.end) for s in r.spans] for r in secret_scan.scan(df).collect()}
    assert found == {i: secret_scan.brute_force(t) for i, t in enumerate(texts)}
    assert secret_scan.scan(df.where("false")).count() == 0
    assert secret_scan.scan(df.unionAll(df)).count() == 2 * len(texts)


def test_secrets_of_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "password=abcdef1", "x", 3), (None, "password=abcdef1", "y", 4)], "doc_id long, text string, kind string, start long")
    assert [(r.doc_id, [s.kind for s in r.spans]) for r in secret_scan.scan(df).collect()] == [(None, ["assign"])] * 2


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = langid.op4_langid(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.9
    assert found.score.between(0, 1).all()


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(4)
    crf = langid.Crf(["a", "b", "c"])
    crf.transitions = rng.normal(size=(3, 3)).astype(np.float32)
    scores = rng.normal(size=(6, 3)).astype(np.float32)
    texts = [np.array([0, 3, 2, 2, 5]), np.array([4]), np.array([], np.int64), np.array([1, 1, 0])]
    sure, labels = np.zeros(4), [()] * 4
    shares = crf.label_shares(texts, np.exp(scores), sure, labels)
    for i, text in enumerate(texts):
        marginal = np.zeros((len(text), 3))
        for path in itertools.product(range(3), repeat=len(text)) if len(text) else ():
            weight = np.exp(sum(scores[w, y] for w, y in zip(text, path, strict=True)) + sum(crf.transitions[a, b] for a, b in itertools.pairwise(path)))
            for t, y in enumerate(path):
                marginal[t, y] += weight
        marginal /= np.maximum(marginal.sum(axis=1, keepdims=True), 1e-300)
        assert np.allclose(shares[i], marginal.mean(axis=0) if len(text) else 0, atol=1e-5)
        assert list(labels[i]) == marginal.argmax(axis=1).tolist()
        assert not len(text) or abs(sure[i] - marginal.max(axis=1).mean()) < 1e-5


def test_words_are_labelled_in_a_mixed_text(spark, edge):
    words = {"de": ["katze", "hund", "schule", "schnee"], "es": ["gato", "perro", "escuela", "nieve"]}
    rng = random.Random(3)
    table = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(sorted(words) * 60)]
    docs = spark.createDataFrame([*table, (900, "Katze, hund " * 6 + "gato perro 12 " * 6, None)], "doc_id long, text string, lang string")
    crf = langid.fit(docs)
    assert crf.lexicon.keys() == {w for own in words.values() for w in own}
    found = langid.predict(docs.unionAll(docs), crf, words="spoken").where("doc_id = 900").collect()
    assert len(found) == 2 and [(x.word, x.lang) for x in found[0].spoken] == [(w, "de") for w in ["katze", "hund"] * 6] + [(w, "es") for w in ["gato", "perro"] * 6]
    assert {len(r.spoken) for r in langid.predict(edge, crf, words="spoken").where("doc_id in (3, 4)").collect()} == {0}


def test_long_words_have_bounded_features():
    assert len(langid.word_features("x" * 100_000)) == len(langid.word_features("x" * langid.LONG_WORD))


def test_language_edge_cases(spark, edge, empty):
    crf = langid.fit(edge)
    found = {r.doc_id: r for r in langid.predict(edge, crf).collect()}
    assert found[3].lang_pred == found[4].lang_pred == "und" and found[3].score == 0
    assert found[1].lang_pred in crf.languages and found[1].n_words == "mine"
    assert langid.predict(empty, crf).count() == 0
    assert {r.lang_pred for r in langid.predict(edge, langid.fit(empty)).collect()} == {"und"}


def test_code_switched_words_follow_their_language():
    rng = random.Random(2)
    words = {0: ["katze", "hund", "schule", "schnee"], 1: ["gato", "perro", "escuela", "nieve"]}
    crf = langid.Crf(["de", "es"])
    crf.train([([rng.choice(words[y]) for _ in range(40)], y) for y in (0, 1) for _ in range(20)], epochs=20)
    mixed = [*words[0] * 3, *words[1]]
    shares = crf.label_shares([np.arange(len(mixed))], np.exp(crf.word_scores(mixed)))[0]
    assert abs(shares[0] - 0.75) < 0.05


def test_lines_brute_force(spark, edge, empty):
    found = {r.doc_id: r for r in lines.dedup_lines(edge).collect()}
    for doc_id, want in lines.brute_force([(i, t) for i, t, *_ in EDGE]).items():
        assert (found[doc_id].n_lines, found[doc_id].n_dropped) == want[:2]
    assert found[2].kept_text == "\nx" and found[1].key == "extra" and found[6].kept_text == ""
    assert lines.dedup_lines(empty).count() == 0


def test_lines_with_a_full_filter(spark, monkeypatch):
    """A filter far past its capacity suspects more lines; the result is the same."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = lines.brute_force([(r.doc_id, r.text) for r in docs.collect()])
    exact = lines._suspects(docs, lines.twice_seen(docs)).count()
    monkeypatch.setattr(lines, "MAX_FILTER_BITS", 1024)
    assert lines._suspects(docs, lines.twice_seen(docs)).count() > exact
    found = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert {i: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for i, r in found.items()} == want


def test_lines_of_null_and_repeated_ids(spark):
    table = [(None, "a line of ten"), (None, "a line of ten"), (7, "a line of ten\nown"), (7, "a line of ten"), (9, "A LINE of ten  \nx"), (9, "a line of ten")]
    found = lines.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.kept_text, r.n_dropped) for r in found) == [(0, "a line of ten", 0)] * 2 + [
        (7, "a line of ten", 0), (7, "a line of ten\nown", 0), (9, "", 1), (9, "x", 1)
    ]


def test_lm_brute_force(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(ngram_lm, "MIN_BATCH_CHARS", 20_000)
    monkeypatch.setattr(ngram_lm, "PART_CHARS", 9_000)
    for order in (1, 2, 3):
        want = ngram_lm.brute_force([(i, t) for i, t, *_ in EDGE], order)
        for r in ngram_lm.backoff_scores(edge, order).collect():
            assert (r.n_words, round(r.log_score, 6)) == (want[r.doc_id][0], round(want[r.doc_id][1], 6))
    assert ngram_lm.backoff_scores(empty).count() == 0
    twice = edge.unionAll(edge).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    found = ngram_lm.backoff_scores(twice).collect()
    assert len(found) == 2 * len(EDGE) and sum(r.doc_id is None for r in found) == 2


def test_decontamination_brute_force(spark, edge, empty, monkeypatch):
    rng, vocabulary = random.Random(1), "a b c".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, bench = [(i, text(rng.randrange(60))) for i in range(40)], [(i, text(rng.randrange(1, 9))) for i in range(12)] + [(99, None), (98, "!"), (97, "ü")]
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 4)
    for window in (1, 4, 10):
        want = decontaminate.brute_force(docs, bench, window)
        found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items(spark, bench), window).collect()
        sha = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
        assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), sha(r["items"]), r.contaminated) for r in found} == want
    twice = spark.createDataFrame([(1, "x a b c " * 20_000), (1, "x a b c " * 20_000), (None, "q")], "doc_id long, text string")
    found = decontaminate.decontaminate(twice, items(spark, [(None, "a b c"), (None, "b c x")]), 3).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in found) == [(0, 1, 0, [])] + [(1, 80_000, 79_999, [""])] * 2
    clean = decontaminate.decontaminate(edge, items(spark, [(1, "beta gamma")]), max_coverage=0.9)
    assert clean.where("doc_id = 1").first().clean_text.startswith("Alpha  delta\n")
    assert decontaminate.decontaminate(empty, items(spark, [])).count() == 0


def test_packing_is_valid_and_tight(spark, edge, empty):
    found = packing.pack(spark.read.parquet(f"{DATA}/documents.parquet")).toPandas()
    for _, bin_ in found.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum().tolist()[:-1]] and bin_.length.sum() <= packing.CAPACITY
    assert found.sequence_id.nunique() <= 1.03 * -(-found.length.sum() // packing.CAPACITY)
    pieces = {r.doc_id: r.length for r in packing.pack(edge).collect()}
    assert pieces[3] == pieces[4] == 1
    assert packing.pack(empty).count() == 0


def test_pieces_equal_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    monkeypatch.setattr(packing, "HELD_IDS", 3000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).unionAll(
        spark.createDataFrame([(None, None), (None, "x"), (None, "x")], "doc_id long, text string")
    ).repartition(20)
    for keep_ids in (True, False):
        found = packing.pack(docs, keep_ids=keep_ids).collect()
        got, want = [], []
        for r in found:
            got.append((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids) if keep_ids else None))
        for doc_id, text in docs.collect():
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
            first = len(ids) % packing.CAPACITY or packing.CAPACITY if len(ids) > packing.CAPACITY else len(ids)
            cuts = [0, *range(first, len(ids) + 1, packing.CAPACITY)] if len(ids) > packing.CAPACITY else [0, len(ids)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                raw = ids[a:b].tobytes()
                want.append((doc_id, k, a, b - a, zlib.crc32(raw), raw if keep_ids else None))
        assert sorted(got, key=repr) == sorted(want, key=repr)
        bins: dict[int, list] = {}
        for r in found:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in bins.values():
            ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
            assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= packing.CAPACITY
        assert len(bins) <= 1.1 * -(-sum(r.length for r in found) // packing.CAPACITY)


def test_hierarchy_merges_partitions(spark):
    docs = spark.createDataFrame([(i, "word " * 300) for i in range(40)], "doc_id long, text string").repartition(40)
    found = packing.pack(docs, keep_ids=False).toPandas()
    assert 14 <= found.sequence_id.nunique() <= 16
    for _, bin_ in found.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum().tolist()[:-1]]


def test_hosts_share_reputation_over_users_and_ports(spark):
    pages = spark.createDataFrame(
        [
            (i, f"http://u{i}@bad.xyz:{80 + i}/p") for i in range(30)
        ] + [(i, f"http://good{i}.com/") for i in range(30, 60)] + [(60, "https://bad.xyz"), (60, "https://bad.xyz")],
        "page_id long, url string"
    ).withColumn("host", F.lit("mine"))
    outcomes = spark.createDataFrame([(i, int(i >= 30)) for i in range(60)], "page_id long, good int")
    found = hosts.filter_urls(pages, outcomes).collect()
    assert [r.verdict for r in found if r.page_id == 60] == ["block"] * 2 and {r.host for r in found if r.page_id == 3} == {"u3@bad.xyz:83"}
    assert {r.verdict for r in found if 30 <= r.page_id < 60} == {"allow"}


def test_url_edge_cases(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, "nothing"), (3, "HTTP://A.Example.COM/en/7x?q#f"), (4, "s://net/de/"), (5, "x://h?y"), (None, "s://sub.org/es/1")],
        "page_id long, url string"
    )
    outcomes = spark.createDataFrame([(5, 0), (5, 1), (None, 0)], "page_id long, good int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.filter_urls(pages, outcomes).collect()}
    assert found[1][:3] == found[2][:3] == ("", "", None)
    assert found[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert found[4] == ("net", "/de/", "net/de/", "block") and found[5][:2] == ("h", "") and found[None][3] == "block"
    assert hosts.filter_urls(pages.where("false"), outcomes).count() == 0


def test_url_query_follows_the_contract(spark, tmp_path):
    urls = ["http://a.net/de/1", "http://x.example.net/de/8", "http://a.com/en/1", "http://example.com/en/7", "http://a.org/es/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.page_id: (r.rule, r.verdict) for r in hosts.op9_url_filter(spark, str(tmp_path)).collect()}
    assert [found[i] for i in range(5)] == [
        ("net/de/", "allow"), ("example.net/de/8", "block"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block")
    ]


def test_simhash_brute_force(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(60)}
    fps = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    root = {r.node: r.root for r in connected_components(links).collect()}
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    group = {}
    for f in fps:
        if f not in group:
            stack = [f]
            group[f] = f
            while stack:
                a = stack.pop()
                for b in fps:
                    if b not in group and near(a, b):
                        group[b] = f
                        stack.append(b)
    ours, theirs = {}, {}
    for f in fps:
        ours.setdefault(root.get(f, f), set()).add(f)
        theirs.setdefault(group[f], set()).add(f)
    assert {frozenset(s) for s in ours.values()} == {frozenset(s) for s in theirs.values()}
    found = {r.doc_id: r for r in simhash.simhash_components(edge).collect()}
    assert found[3].fp == found[4].fp == 0 and found[4].component_id == 3 and found[6].component_id == 5
    assert simhash.simhash_components(empty).count() == 0
    twice = spark.createDataFrame(
        [(None, "a b c d"), (None, "a b c d"), (8, "A b  c\td"), (8, "a b c d"), (None, "z"), (None, None)], "doc_id long, text string"
    )
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.simhash_components(twice).collect()) == [(0, 0), (0, 0), (0, 8), (0, 8), (8, 8), (8, 8)]


@pytest.mark.parametrize("text", ["", None, "one", "One  two\x1fx", "a b c", "a b c d a b c d a b c", "é Ü " * 30])
def test_fingerprint_counts_bits(text):
    import re

    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    assert simhash.fingerprint(None if text is None else text.encode()) & (1 << 64) - 1 == want


def test_ring_chain_is_the_distance():
    rng = np.random.default_rng(2)
    x = np.array([sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for n in range(40) for _ in range(30)], np.uint64)
    for distance in (3, 12, 22):
        assert (simhash.ring_chain(x, distance) == (np.bitwise_count(x) <= distance)).all()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        assert docs.columns == columns and 0.8 * n <= docs.count() <= n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).select("doc_id").distinct().count() == docs.count()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.decontaminate(docs, bench).where("contaminated").count() == 0


def test_pipeline_leaves_no_words_in_the_workers(spark):
    import corpus_pipeline
    import pyarrow as pa

    from quire.llm import tokens

    docs = spark.createDataFrame([(i, "word wyrdforpipeline" + "abcd"[i % 4]) for i in range(40)], "doc_id long, text string").repartition(8)
    assert corpus_pipeline.pack_sequences(spark, docs, DATA).count() == 40

    def held(batches):
        words = [w for e in tokens._encoders.values() for w in (*e.known, *e.older)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(b"wyrdforpipeline" in w for w in words)])], ["n"])

    assert [r.n for r in spark.range(0, 16, 1, 16).mapInArrow(held, "n long").collect()] == [0] * 16


def test_released_memory_leaves_the_process():
    import pyarrow as pa

    from quire.llm.common import release_memory

    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024

    held = [pa.array(np.arange(1 << 17)).cast(pa.string()) for _ in range(100)]
    most = anonymous()
    del held
    release_memory()
    assert anonymous() < most - 100


def near_texts():
    rng = random.Random(8)
    texts: list[str | None] = [None, "", " ", "one two", "One  two", "one two three four five", "one two three four six"]
    for n in (9, 30, 120, 400):
        base = [str(rng.randrange(5000)) for _ in range(n)]
        for _ in range(22):
            copy, edits = base[:], rng.randrange(1, 2 + n // 40)
            for _ in range(edits):
                copy[rng.randrange(n)] = str(rng.randrange(5000))
            texts.append(" ".join(copy))
        texts.append(" ".join(base + base))
    passage = " ".join(str(rng.randrange(5000)) for _ in range(40))
    texts += [f"{passage} " + " ".join(str(rng.randrange(5000)) for _ in range(50)) for _ in range(30)]
    return texts


@pytest.mark.parametrize("sample", [1, 16])
def test_near_copies_brute_force(spark, empty, monkeypatch, sample):
    import corpus_pipeline

    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "STAR_SIZE", 4)
    monkeypatch.setattr(near, "SAMPLE", sample)
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i for i, least in enumerate(near.brute_force(texts)) if i == least}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()} == want
    assert corpus_pipeline.drop_near_copies(spark, empty, DATA).count() == 0


def test_near_copies_recall(spark):
    """Pairs just at 0.8, in which the fingerprints differ most."""
    rng = random.Random(12)
    texts = []
    for n in (5, 10, 40, 300):
        for _ in range(60):
            base = [str(rng.randrange(10**6)) for _ in range(n + 4)]
            cut = -(-n // 5)  # of n shingles all but these are shared
            texts += [" ".join(base), " ".join(base[: n + 4 - cut])]
    rows_ = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    group = {r.row: r.component for r in near.near_groups(rows_).collect()}
    pairs = [(i, i + 1) for i in range(0, len(texts), 2) if near.alike(*(near.shingle_set(texts[k].encode()) for k in (i, i + 1)))]
    assert len(pairs) > 200 and np.mean([group[a] == group[b] for a, b in pairs]) > 0.99


def test_sketches_leave_all_alike():
    """No pair at 0.8 is excluded, also just at it and across sketch lengths; pairs at a half mostly are."""
    rng = np.random.default_rng(5)
    left = []
    for n in (1, 2, 5, 9, 31, 63, 64, 65, 130, 500, 1030, 4100):
        for _ in range(40):
            pool = rng.integers(0, 2**64, 2 * n, np.uint64)
            a = np.unique(pool[:n])
            inside, beside = np.unique(pool[: -(-4 * n // 5)]), np.unique(np.r_[a, pool[n : n + n // 4]])
            for b in (a, inside, beside, np.unique(np.r_[a[n // 9 :], pool[n : n + n // 9]])):
                assert near.alike(a, b) and near.maybe_alike(near.sketch_of(a), near.sketch_of(b)) and near.maybe_alike(near.sketch_of(b), near.sketch_of(a))
            if n >= 500:
                b = np.unique(pool[n // 3 : n + n // 3])
                assert not near.alike(a, b)
                left.append(near.maybe_alike(near.sketch_of(a), near.sketch_of(b)))
    assert np.mean(left) < 0.05
    none = near.sketch_of(np.empty(0, np.uint64))
    assert near.maybe_alike(none, none) and not near.maybe_alike(none, near.sketch_of(a))


def test_near_copies_ship_few_sets(spark, monkeypatch):
    """Texts that share a passage meet by sketch; the sets of those that are no copies are never read."""
    monkeypatch.setattr(near, "STAR_SIZE", 4)
    monkeypatch.setattr(near, "SAMPLE", 1 << 40)
    read, sets = [], near._sets

    def noted(*args):
        read.append(sets(*args))
        return read[-1]

    monkeypatch.setattr(near, "_sets", noted)
    rng = random.Random(3)
    word = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    passage = word(150)
    texts = [f"{passage} {word(200)}" for _ in range(60)]
    texts += [f"{t} {word(3)}" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumn("doc_id", F.col("row"))
    group = {r.row: r.component for r in near.near_groups(docs).collect()}
    assert len(set(group.values())) == 60 and all(group[i] == group[60 + i] for i in range(5))
    assert sum(x.count() for x in read) <= 20


def test_pipeline_stages_at_the_edges(spark):
    import corpus_pipeline

    long = "The house by the river was old and the people of the town said that nobody had lived there for many years. " * 3
    table = [
        (1, long, "en", "a", 1), (1, long, "en", "a", 1), (None, long + "More.", "en", None, None), (None, None, None, "b", 0),
        (4, "", "fr", "b", 0), (5, "x" * 100_000, None, "c", 9)
    ]
    docs = spark.createDataFrame(
        table, "doc_id long, text string, lang string, source string, n_chars long"
    ).withColumn("component", F.lit("mine")).withColumn("n_words", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.where("false"), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= len(table)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), DATA).count() == 0
    assert corpus_pipeline.remove_benchmark(spark, docs, DATA).count() == len(table)
    assert corpus_pipeline.drop_repeated_lines(spark, docs, DATA).count() == len(table)
    left = corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in left) == [(1, len(long)), (4, 0), (5, 100_000)]
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, DATA).collect()} <= {None, 1, 5}


def test_pipeline_keeps_mixed_and_unlabelled_documents(spark):
    import corpus_pipeline

    words = {"de": ["katze", "hund", "schule", "schnee"], "es": ["gato", "perro", "escuela", "nieve"], "fr": ["chaton", "chienne", "lycée", "neige"]}
    rng = random.Random(3)
    one = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(150))
    table = [(i, one(lang), lang) for i, lang in enumerate(sorted(words) * 200)] + [(9000, " ".join(map(one, sorted(words))), None), (9001, "12 34", None)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    found = langid.predict(docs, langid.fit(docs)).where("doc_id = 9000").first()
    assert found.score < corpus_pipeline.MIN_SCORE
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, DATA).collect()} == {r[0] for r in table} - {9001}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, unlabelled, DATA).collect()} == {r[0] for r in table} - {9001}


def test_near_copies_leave_one_row(spark):
    import corpus_pipeline

    a, b = " ".join(map(str, range(50))), " ".join(map(str, range(100, 150)))
    table = [(1, a), (1, a), (2, a + " x"), (None, a), (None, b), (None, b), (5, "alone")]
    found = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(table, "doc_id long, text string").repartition(4), DATA).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == [(0, b), (1, a), (5, "alone")]


def test_every_language_label_is_learned(spark, monkeypatch):
    table = [(i, f"stem{'abcdefghij'[i % 70 // 10]}{'abcdefghij'[i % 10]} " * 5, f"l{i % 70:02}") for i in range(700)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    assert {lang for _, lang in langid.training_sample(docs)} == {r[2] for r in table}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 69)
    with pytest.raises(ValueError, match="69"):
        langid.fit(docs)
