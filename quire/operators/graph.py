"""Property-graph construction, integrity checks and traversal over nodes and edges.

nodes: label, key, name and properties; edges: src_label, src_key, rel_type, dst_label, dst_key and properties. Unless an operator says
otherwise: (label, key) is unique among nodes, edges that repeat count each, null labels and keys join nothing, null names are shown by
key, orders end with label and key so that there are no ties, and empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import ENTITIES, NER_TYPES, RELATION_ALIASES, RELATIONS, TYPE_ALIASES, entity_frame
from ._durable import durable

EDGE_KEY = ["src_label", "src_key", "rel_type", "dst_label", "dst_key"]
MOST_LABELS = 1000
"""Labels that may stand in the plan."""


def _alias(column: Column, aliases: dict[str, Iterable[str]]) -> Column:
    out = column
    for target, names in aliases.items():
        out = F.when(column.isin(*names), F.lit(target)).otherwise(out)
    return out


def remap_entity_type(raw: Column | str) -> Column:
    """The canonical entity type, or null for one that stays unknown."""
    mapped = _alias(T.col(raw), TYPE_ALIASES)
    return F.when(mapped.isin(*ENTITIES), mapped)


def remap_relation_type(raw: Column | str) -> Column:
    mapped = _alias(T.col(raw), RELATION_ALIASES)
    return F.when(mapped.isin(*RELATIONS), mapped)


def ner_type(label: Column | str) -> Column:
    mapped = _alias(T.col(label), NER_TYPES)
    return F.when(mapped.isin(*NER_TYPES), mapped)


def entity_problem(name: Column | str, type_: Column | str) -> Column:
    """Why an entity is refused on import, or null: blank, a type with a blank, or a dotted type of lower-case start."""
    t = T.col(type_)
    blank = lambda c: F.coalesce(T.strip(c) == "", F.lit(True))
    return F.when(blank(t), "blank type").when(blank(T.col(name)), "blank name").when(F.contains(t, F.lit(" ")), "blank in type").when(
        F.contains(t, F.lit(".")) & ~F.rlike(t, F.lit(r"^\p{Lu}")), "dotted type"
    )


def node_key(type_: Column | str, name: Column | str, properties: Column | str) -> Column:
    """The value of the key property of a type, or else the entity's name."""
    p = T.col(properties)
    keyed = F.when(T.col(type_) == "Document", p["doc_id"]).when(T.col(type_) == "Reference", p["value"]).otherwise(p["name"])
    return F.coalesce(keyed, T.col(name))


def merge_nodes(rows: DataFrame, properties: list[str], order: str = "seq") -> DataFrame:
    """One node a (label, key): of each property the last value that is not null."""
    last = [F.max_by(F.col(p), F.when(F.col(p).isNotNull(), F.col(order))).alias(p) for p in properties]
    return rows.groupBy("label", "key").agg(*last)


def merge_edges(rows: DataFrame, nodes: DataFrame, properties: list[str], order: str = "seq") -> DataFrame:
    """One edge a (source, type, target) of which both ends exist; the last value of each property that is not null."""
    ends = nodes.select("label", "key").distinct()
    for side in ("src", "dst"):
        rows = rows.join(ends.select(F.col("label").alias(f"{side}_label"), F.col("key").alias(f"{side}_key")), [f"{side}_label", f"{side}_key"], "left_semi")
    last = [F.max_by(F.col(p), F.when(F.col(p).isNotNull(), F.col(order))).alias(p) for p in properties]
    return rows.groupBy(*EDGE_KEY).agg(*(last or [F.count("*").alias("seen")]))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by label and relations by type."""
    count = lambda df, kind, by: df.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(nodes, "node", "label").unionByName(count(edges, "relation", "rel_type"))


def largest_first(counted: DataFrame) -> DataFrame:
    """Statistics (kind, name, n) with the largest of each kind first."""
    return counted.orderBy("kind", F.desc("n"), "name")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src_label").alias("label"), F.col("src_key").alias("key")).unionAll(
        edges.select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"))
    )


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(_ends(edges).distinct(), ["label", "key"], "left_anti")


def _labels(nodes: DataFrame) -> list[str] | None:
    """The labels of nodes, or none if there are more than ``MOST_LABELS``."""
    found = [r.label for r in nodes.select("label").distinct().limit(MOST_LABELS + 1).collect()]
    return None if len(found) > MOST_LABELS else [x for x in found if x is not None]


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, key, degree); a self-loop counts once."""
    loop = (F.col("src_label") == F.col("dst_label")) & (F.col("src_key") == F.col("dst_key"))
    ends = edges.select(F.col("src_label").alias("label"), F.col("src_key").alias("key")).unionAll(
        edges.where(~loop).select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"))
    )
    return nodes.select("label", "key").join(ends.groupBy("label", "key").agg(F.count("*").alias("degree")), ["label", "key"], "left").fillna(0, ["degree"])


def duplicate_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, rel_type, dst, n) by display names where n > 1."""
    shown = nodes.select("label", "key", F.coalesce("name", "key").alias("shown"))
    for side in ("src", "dst"):
        edges = edges.join(
            shown.select(F.col("label").alias(f"{side}_label"), F.col("key").alias(f"{side}_key"), F.col("shown").alias(side)),
            [f"{side}_label", f"{side}_key"]
        )
    return edges.groupBy("src", "rel_type", "dst").agg(F.count("*").alias("n")).where("n > 1")


def missing_properties(nodes: DataFrame) -> DataFrame:
    """(label, key, property): required properties that a node (with a map ``props``) lacks."""
    wanted = F.broadcast(entity_frame(nodes.sparkSession).select("label", F.explode("required").alias("property")))  # a fixed schema
    return nodes.join(wanted, "label").where(F.col("props")[F.col("property")].isNull()).select("label", "key", "property")


def first_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def invalid_predicates(edges: DataFrame) -> DataFrame:
    """(rel_type, valid): the distinct types."""
    return edges.select("rel_type").distinct().withColumn("valid", F.col("rel_type").isin(*RELATIONS))


def provenance(nodes: DataFrame) -> DataFrame:
    """(label, n, missing, blank, missing_share) of column source_text."""
    return nodes.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("source_text").isNull()).alias("missing"),
        F.count_if(F.col("source_text") == "").alias("blank")
    ).withColumn("missing_share", F.round(F.col("missing") / F.col("n"), 6))


def fragmentation(nodes: DataFrame) -> DataFrame:
    """(label, norm, variants, n): names of a label that differ only in case and outer blanks."""
    norm = T.fragment_key("name")
    return nodes.where(F.col("name").isNotNull() & (norm != "")).groupBy("label", norm.alias("norm")).agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("n")
    ).where("n > 1").select("label", "norm", F.array_join("names", "|").alias("variants"), "n")


def neighbors(seeds: DataFrame, edges: DataFrame, rel_types: list[str] | None = None) -> DataFrame:
    """(label, key, direction, rel_type, n_label, n_key) of each seed (label, key)."""
    if rel_types:
        edges = edges.where(F.col("rel_type").isin(*rel_types))
    sides = []
    for direction, own, other in (("outgoing", "src", "dst"), ("incoming", "dst", "src")):
        e = edges.select(
            F.col(f"{own}_label").alias("label"), F.col(f"{own}_key").alias("key"), F.lit(direction).alias("direction"), "rel_type",
            F.col(f"{other}_label").alias("n_label"), F.col(f"{other}_key").alias("n_key")
        )
        sides.append(seeds.select("label", "key").join(e, ["label", "key"]))
    return sides[0].unionByName(sides[1])


def keyword_entities(queries: DataFrame, nodes: DataFrame, per_keyword: int = 5, most: int = 5) -> DataFrame:
    """(query_id, ord, label, key, name): nodes whose name holds a query word of over two characters, first seen first.

    Names are cut into the substrings of word lengths that queries use, so the containment test is an equi-join.
    """
    words = queries.select("query_id", F.posexplode(T.tokens("text")).alias("pos", "kw")).where(F.length("kw") > 2)
    words = words.groupBy("query_id", "kw").agg(F.min("pos").alias("pos"))
    lengths = sorted(r.n for r in words.select(F.length("kw").alias("n")).distinct().collect())
    if not lengths:
        lengths = [1]
    low = F.lower("name")
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                F.lit(lengths),
                lambda n: F.when(
                    F.length(low) >= n,
                    F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, n))
                ).otherwise(F.array().cast("array<string>"))
            )
        )
    )
    named = nodes.where("name is not null and name <> ''").select("label", "key", "name", F.explode(grams).alias("kw"))
    ranked = first_per_group(named.join(words.select("kw").distinct(), "kw", "left_semi"), ["kw"], ["name", "label", "key"], per_keyword)
    found = words.join(ranked, "kw")
    seen = first_per_group(found, ["query_id", "label", "key"], ["pos", "name"], 1)
    w = Window.partitionBy("query_id").orderBy("pos", "name", "label", "key")
    return seen.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most).select("query_id", "ord", "label", "key", "name")


def _steps(edges: DataFrame) -> DataFrame:
    """(e, a_label, a_key, b_label, b_key): every edge in both directions; a self-loop once."""
    return _directed(edges, "src").unionAll(_directed(edges, "dst"))


MOST_BROADCAST = 1 << 18
"""Nodes (label, key) that may be broadcast."""


def _steps_from(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The steps of ``_steps`` that start at one of ``nodes`` (label, key), a written table.

    Edges are looked up as they are read: where they were made distinct, the look-up goes before that. Few nodes are
    broadcast; else both sides are shuffled.
    """
    few = nodes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    sides = []
    for side in ("src", "dst"):
        own = nodes.select(F.col("label").alias(f"{side}_label"), F.col("key").alias(f"{side}_key"))
        near = edges.join(F.broadcast(own) if few else own, [f"{side}_label", f"{side}_key"], "left_semi")
        sides.append(_directed(near, side))
    return sides[0].unionAll(sides[1])


def _directed(edges: DataFrame, side: str) -> DataFrame:
    """Edges as steps (e, a_label, a_key, b_label, b_key) from ``side``, src or dst; a self-loop only from src."""
    other = "dst" if side == "src" else "src"
    if side == "dst":
        edges = edges.where("not (src_label = dst_label and src_key = dst_key)")
    ends = [F.col(f"{s}_{c}").alias(f"{t}_{c}") for s, t in ((side, "a"), (other, "b")) for c in ("label", "key")]
    return edges.select(F.xxhash64(*EDGE_KEY).alias("e"), *ends)


def _walks(seeds: DataFrame, steps: DataFrame, hops: int) -> list[DataFrame]:
    """For 1 to ``hops`` steps (label, key, b_label, b_key, used): undirected walks over different edges."""
    at = seeds.select("label", "key", F.col("label").alias("a_label"), F.col("key").alias("a_key"), F.array().cast("array<bigint>").alias("used"))
    out = []
    for _ in range(hops):
        step = at.join(steps, ["a_label", "a_key"]).where(~F.array_contains("used", F.col("e")))
        step = step.select("label", "key", "b_label", "b_key", F.array_append("used", F.col("e")).alias("used"))
        out.append(step)
        at = step.withColumnsRenamed({"b_label": "a_label", "b_key": "a_key"})
    return out


def paths_to_documents(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(label, key, doc, hops, n): undirected paths of up to ``hops`` different edges from a seed to a Document.

    Edges are told apart by a 64-bit hash of their key. The paths to one document are counted on the map side.
    """
    out = None
    for h, walk in enumerate(_walks(seeds, _steps(edges), hops), 1):
        docs = walk.where("b_label = 'Document'").groupBy("label", "key", F.col("b_key").alias("doc")).agg(F.count("*").alias("n")).withColumn("hops", F.lit(h))
        out = docs if out is None else out.unionByName(docs)
    return out.select("label", "key", "doc", "hops", "n")


def first_paths(seeds: DataFrame, edges: DataFrame, hops: int = 2, most: int = 30) -> DataFrame:
    """(label, key, doc, hops, n): of each seed the ``most`` first paths to Documents, by hops and document.

    Each task keeps no more than ``most`` paths of a seed and length before they are shuffled, and a seed whose
    shorter paths suffice walks no further. Of the edges only those at the nodes reached are taken.
    """
    at = seeds.select("label", "key", F.col("label").alias("a_label"), F.col("key").alias("a_key"), F.array().cast("array<bigint>").alias("used"))
    kept = None
    for h in range(1, hops + 1):
        at = durable(at, "walks")
        reached = durable(at.select(F.col("a_label").alias("label"), F.col("a_key").alias("key")).distinct(), "reached")
        step = at.join(_steps_from(edges, reached), ["a_label", "a_key"]).where(~F.array_contains("used", F.col("e")))
        docs = first_per_group(
            step.where("b_label = 'Document'").select("label", "key", F.col("b_key").alias("doc"), F.lit(h).alias("hops")),
            ["label", "key"], ["doc"], most
        )
        kept = durable(docs if kept is None else first_per_group(kept.unionByName(docs), ["label", "key"], ["hops", "doc"], most), "paths")
        if h < hops:
            full = kept.groupBy("label", "key").agg(F.count("*").alias("n")).where(F.col("n") >= most)
            step = step.select(
                "label", "key", F.col("b_label").alias("a_label"), F.col("b_key").alias("a_key"),
                F.array_append("used", F.col("e")).alias("used")
            )
            at = step.join(full.select("label", "key"), ["label", "key"], "left_anti")
    return kept.groupBy("label", "key", "doc", "hops").agg(F.count("*").alias("n"))


def graph_retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10, hops: int = 2, most_paths: int = 30) -> DataFrame:
    """(query_id, rank, id, score): Documents near the entities a query names, by the sum of 1 / entity rank / hops over paths."""
    found = durable(keyword_entities(queries, nodes), "entities")
    paths = first_paths(found.select("label", "key").distinct(), edges, hops, most_paths)
    score = F.sum(F.col("n") / F.col("ord") / F.col("hops"))
    scored = found.join(paths, ["label", "key"]).groupBy("query_id", F.col("doc").alias("id")).agg(score.alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def exact_groups(nodes: DataFrame) -> DataFrame:
    """(label, norm, key, name): nodes that share a normalised name with another of their label."""
    named = nodes.where("name is not null").withColumn("norm", T.normalize_name("name")).where("norm <> ''")
    many = named.groupBy("label", "norm").agg(F.count("*").alias("n")).where("n > 1").select("label", "norm")
    return named.join(many, ["label", "norm"]).select("label", "norm", "key", "name")


def canonical_pick(groups: DataFrame, degree: DataFrame) -> DataFrame:
    """(label, key, canon): of each group (label, norm, key) the node of most relations, ties to the smaller key."""
    ranked = groups.join(degree, ["label", "key"])
    w = Window.partitionBy("label", "norm").orderBy(F.desc("degree"), "key")
    canon = ranked.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("label", "norm", F.col("key").alias("canon"))
    return ranked.join(canon, ["label", "norm"]).select("label", "norm", "key", "canon")


def repoint(edges: DataFrame, picked: DataFrame) -> DataFrame:
    """Edges with duplicates' ends moved to their canonical nodes; edges that become self-loops go, equal ones merge.

    Only ends of a label that has duplicates are joined with them.
    """
    moved = durable(picked.where("key <> canon").select("label", "key", "canon"), "moved")
    labels = _labels(moved)
    for side in ("src", "dst"):
        m = moved.select(F.col("label").alias(f"{side}_label"), F.col("key").alias(f"{side}_key"), F.col("canon").alias(f"{side}_canon"))
        own = F.lit(True) if labels is None else F.coalesce(F.col(f"{side}_label").isin(labels), F.lit(False))
        rest = edges.where(~own).withColumn(f"{side}_canon", F.lit(None).cast(moved.schema["canon"].dataType))
        edges = edges.where(own).join(m, [f"{side}_label", f"{side}_key"], "left").unionByName(rest)
    touched = F.col("src_canon").isNotNull() | F.col("dst_canon").isNotNull()
    src, dst = F.coalesce("src_canon", "src_key"), F.coalesce("dst_canon", "dst_key")
    out = edges.select("src_label", src.alias("src_key"), "rel_type", "dst_label", dst.alias("dst_key"), touched.alias("t"))
    return out.where("not (t and src_label = dst_label and src_key = dst_key)").select(*EDGE_KEY).distinct()


def similar_names(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(label, a, b): pairs a < b of keys whose names (label, key, norm) have an indel similarity of at least ``threshold``.

    An insertion or deletion changes two of a name's character pairs at most, so names that similar share at least
    (4 * threshold - 3) * n + 1 of them, n being the longer length; in the order of frequency, rare pairs first, they share one
    among the first n + 2 less that number. Only names that meet there are compared. Blank names are like none.
    """
    from ..functions.metrics import similarity

    if threshold <= 0.75:
        raise ValueError("the pair filter needs a threshold above 0.75")
    edged = F.concat(F.lit("\x02"), F.col("norm"), F.lit("\x03"))
    own = names.where("norm <> ''").select(
        "label", "key", "norm",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.length("norm") + 1), lambda i: F.substring(edged, i, 2))).alias("at", "pair")
    )
    # The n-th occurrence of a pair in a name is an element of its own.
    nth = Window.partitionBy("label", "key", "norm", "pair").orderBy("at")
    own = durable(own.withColumn("nth", F.row_number().over(nth)).drop("at"), "name-pairs")
    often = own.groupBy("label", "pair", "nth").agg(F.count("*").alias("often"))
    ordered = F.array_sort(F.collect_list(F.struct("often", "pair", "nth")))
    shared = F.ceil(F.length("norm") * (4 * threshold - 3) - 1e-9) + 1
    first = own.join(often, ["label", "pair", "nth"]).groupBy("label", "key", "norm").agg(ordered.alias("p"))
    keys = first.select(
        "label", "key", "norm", F.explode(F.slice("p", 1, (F.length("norm") + 2 - shared).cast("int"))).alias("p")
    ).select("label", "key", "norm", "p.pair", "p.nth")
    a = keys.select("label", "pair", "nth", F.col("key").alias("a"), F.col("norm").alias("n1"))
    b = keys.select("label", "pair", "nth", F.col("key").alias("b"), F.col("norm").alias("n2"))
    short, long = F.least(F.length("n1"), F.length("n2")), F.greatest(F.length("n1"), F.length("n2"))
    near = a.join(b, ["label", "pair", "nth"]).where("a < b").where(
        short + 1e-9 >= long * threshold / (2 - threshold)
    ).select("label", "a", "b", "n1", "n2").distinct()
    return near.where(similarity("n1", "n2") >= threshold).select("label", "a", "b")


def fuzzy_groups(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(label, key, leader): greedy leaders over names (label, key, norm) in key order.

    A name that is like no leader before it leads; any other follows its first leader. Equal names are like the same ones, so
    all follow the leader of the first of them, and only those first ones are compared. A round settles every name whose
    earlier likes are all settled, so there are as many rounds as the longest such chain, and no task sees a whole label.
    """
    firsts = durable(names.where("norm <> ''").groupBy("label", "norm").agg(F.min("key").alias("key")), "first-names")
    pairs = durable(similar_names(firsts, threshold), "similar")
    settled = names.select("label", "key").where("false").withColumn("leader", F.lit("").cast("string"))
    waiting = durable(pairs.select("label", F.col("a").alias("key")).unionByName(pairs.select("label", F.col("b").alias("key"))).distinct(), "waiting")
    while not waiting.isEmpty():
        before = pairs.select("label", F.col("b").alias("key"), F.col("a").alias("other"))
        states = settled.select("label", F.col("key").alias("other"), "leader")
        seen = before.join(waiting, ["label", "key"], "left_semi").join(states, ["label", "other"], "left")
        leads = F.col("leader") == F.col("other")
        found = seen.groupBy("label", "key").agg(
            F.bool_or(F.col("leader").isNull()).alias("open"), F.min(F.when(leads, F.col("other"))).alias("first"),
            F.min(F.when(F.col("leader").isNull(), F.col("other"))).alias("first_open")
        )
        now = waiting.join(found, ["label", "key"], "left")
        # A leader settles its follower as soon as no open name before that leader is left.
        done = now.where(~F.coalesce("open", F.lit(False)) | (F.col("first") < F.col("first_open")))
        done = done.select("label", "key", F.coalesce("first", "key").alias("leader"))
        settled = durable(settled.unionByName(done), "settled")
        waiting = durable(waiting.join(settled, ["label", "key"], "left_anti"), "waiting")
    found = firsts.join(settled, ["label", "key"], "left").select("label", "norm", F.coalesce("leader", "key").alias("leader"))
    return names.join(durable(found, "leaders"), ["label", "norm"], "left").select("label", "key", F.coalesce("leader", "key").alias("leader"))


def canonicalize(nodes: DataFrame, edges: DataFrame, threshold: float = 0.85, labels: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, nodes, edges) with duplicates of one label merged into their canonical nodes.

    plan has (label, key, canon): first nodes of equal normalised names, then, among names that no other equals, names that
    are similar; of each group the node of most relations stays. A node that stays gains ``aliases``, the other names of its
    group. The plan alone is the dry run. ``labels`` limits the labels that are merged.
    """
    some = nodes if labels is None else nodes.where(F.col("label").isin(*labels))
    degree = durable(degrees(some, edges), "degrees")
    exact = durable(exact_groups(some), "exact-groups")
    single = some.where("name is not null").withColumn("norm", T.normalize_name("name")).where("norm <> ''").join(
        exact.select("label", "key"), ["label", "key"], "left_anti"
    )
    similar = fuzzy_groups(single.select("label", "key", "norm"), threshold).select("label", "key", F.concat(F.lit("\x00"), "leader").alias("norm"))
    many = similar.groupBy("label", "norm").agg(F.count("*").alias("n")).where("n > 1").select("label", "norm")
    groups = exact.select("label", "norm", "key").unionByName(similar.join(many, ["label", "norm"], "left_semi").select("label", "norm", "key"))
    plan = durable(canonical_pick(groups, degree).where("key <> canon").select("label", "key", "canon"), "canonical")
    names = plan.join(
        nodes.select("label", "key", "name"), ["label", "key"]
    ).groupBy("label", F.col("canon").alias("key")).agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    kept = nodes.join(plan, ["label", "key"], "left_anti").join(names, ["label", "key"], "left")
    return plan, kept, repoint(edges, plan)


def integrity_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sizes, and counts and shares of orphans, duplicate relations, lacking properties, unknown types, lacking provenance and fragmented names.

    Shares of empty wholes are 0. All relations that repeat a relation between equal names count once for each such pair.
    """
    share = lambda part, whole: F.round(T.ratio(F.col(part), F.col(whole)), 6)
    one = nodes.agg(F.count("*").alias("total_nodes"), F.count_if(F.col("source_text").isNull()).alias("missing_provenance"))
    parts = [
        edges.agg(F.count("*").alias("total_relations")),
        orphans(nodes, edges).agg(F.count("*").alias("orphan_nodes")),
        duplicate_relations(edges, nodes).agg(F.count("*").alias("duplicate_relations")),
        missing_properties(nodes).agg(F.count("*").alias("schema_violations")),
        invalid_predicates(edges).agg(F.count("*").alias("predicates"), F.count_if(~F.col("valid")).alias("invalid_predicates")),
        fragmentation(nodes).agg(F.count("*").alias("fragmented_entities")),
    ]
    for part in parts:
        one = one.crossJoin(part)  # one row each
    return one.withColumns({
        "orphan_ratio": share("orphan_nodes", "total_nodes"),
        "duplicate_ratio": share("duplicate_relations", "total_relations"),
        "invalid_predicate_ratio": share("invalid_predicates", "predicates"),
        "missing_provenance_ratio": share("missing_provenance", "total_nodes"),
    }).drop("predicates")


def subgraph(spark, nodes: DataFrame, edges: DataFrame, query: str, **parameters) -> DataFrame:
    """A parameterised SQL query over the views ``nodes`` and ``edges``."""
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")
    return spark.sql(query, args=parameters or None)
