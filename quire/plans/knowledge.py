"""Queries of answer parsing, graph import, look-ups and integrity, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, knowledge
from . import tables as D
from .registry import register

# ---- answers of a model: events in the words of an answer, some of them fenced, wrapped, cut off or unreadable --------------

_KIND = {"click": "Company", "view": "City", "purchase": "DATE", "signup": "Document"}


def _answers(spark, sf):
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.lit("Person")
    for raw, to in _KIND.items():
        kind = F.when(t == raw, F.lit(to)).otherwise(kind)
    k, own = (i % 97).cast("string"), F.concat(F.lit("a"), i.cast("string"))
    entity = F.concat(F.lit('{"name": "o\'neil-'), k, F.lit('", "type": "'), kind, F.when(i % 3 == 0, F.lit('", "confidence": 0.9}')).otherwise('"}'))
    entities = F.concat(F.lit('{"entities": ['), entity, F.lit(', {"name": "  ", "type": "City"}, {"name": "x", "type": "Unknown"}], "relations": ['))
    one = F.concat(
        F.lit('{"source": "oneil-'), k, F.lit('", "target": "'), own, F.lit('", "type": "MENTIONS"}, {"source": "oneil-'), k,
        F.lit('", "target": "ghost", "type": "RELATED_TO"}, ')
    )
    body = F.concat(entities, one, F.lit('{"source": "'), own, F.lit('", "target": "oneil-'), k, F.lit('", "type": "nonsense"}'))
    json = F.concat(body, F.lit("]}"))
    fenced = F.concat(F.lit("<think>hm {x}</think>\n```json\n"), json, F.lit("\n```"))
    text = F.when(i % 10 == 0, fenced).when(
        i % 10 == 1, F.concat(F.lit("Here: "), json, F.lit(" done"))
    ).when(i % 10 == 2, F.concat(body, F.lit(","))).when(i % 10 == 3, "nothing").otherwise(json)
    return D.table(spark, sf, "events").select(own.alias("extraction"), text.alias("answer"))


_ANSWERED = """answered AS (SELECT 'a' || event_id AS extraction, event_id, 'oneil-' || (event_id % 97) AS name,
  CASE event_type WHEN 'click' THEN 'Organization' WHEN 'view' THEN 'Location' WHEN 'purchase' THEN 'Reference'
  WHEN 'signup' THEN 'Document' ELSE 'Person' END AS type
  FROM events WHERE event_id % 10 <> 3)"""


@register(f"""WITH {_ANSWERED}
SELECT extraction, 0 AS ord, CASE WHEN type = 'Document' THEN extraction ELSE name END AS name, type, CASE
  WHEN event_id % 3 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN type = 'Document' THEN extraction END AS doc_id FROM answered
UNION ALL SELECT extraction, 3, extraction, 'Document', 1.0, extraction FROM answered WHERE type <> 'Document'""")
def answer_entities(spark, sf):
    found = knowledge.answer_entities(knowledge.read_answers(_answers(spark, sf)))
    return found.select("extraction", "ord", "name", "type", "confidence", F.col("properties")["doc_id"].alias("doc_id"))


@register(
    f"WITH {_ANSWERED} SELECT extraction, 0 AS ord, name AS source, extraction AS target, 'RELATED_TO' AS type, CAST(0.5 AS DOUBLE) AS "
    f"confidence FROM answered WHERE type <> 'Document'"
)
def answer_relations(spark, sf):
    parsed = knowledge.read_answers(_answers(spark, sf))
    return knowledge.answer_relations(parsed, knowledge.answer_entities(parsed)).select("extraction", "ord", "source", "target", "type", "confidence")


# ---- import -------------------------------------------------------------------------------------------------


def _raw(spark, sf):
    """Entities and relations as extractors leave them, with blanks, bad types and repeated names."""
    i, t = F.col("event_id"), F.col("event_type")
    events = D.table(spark, sf, "events").withColumn("extraction", F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")))
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    type_ = F.when(t == "click", "Person").when(t == "view", "Organization").when(t == "purchase", "Reference").when(t == "signup", "Document").when(i % 2 == 0, "bug.report").otherwise("Some Type")
    given = F.when(
        (t == "purchase") & (i % 3 == 0), F.create_map(F.lit("value"), text("R", i % 53))
    ).when(t == "view", F.create_map(F.lit("domain"), text("d", i % 7))).when(t == "signup", F.create_map(F.lit("doc_id"), text("D", i % 29)))
    properties = F.coalesce(given, F.create_map().cast("map<string,string>"))
    name = lambda n: F.concat(t, F.lit("-"), (n % 97).cast("string"))
    rest = [((i % 10) / 10).alias("confidence"), text("s", i % 5).alias("source_text"), i.alias("seq")]
    entities = events.select(
        "extraction", i.alias("ord"), F.when(i % 13 == 0, " ").otherwise(name(i)).alias("name"), type_.alias("type"),
        properties.alias("properties"), *rest
    )
    kind = F.when(i % 4 == 0, " ").otherwise("RELATED_TO")
    relations = events.select(
        "extraction", i.alias("ord"), name(i).alias("source"), name(i * 7).alias("target"), kind.alias("type"),
        F.create_map().cast("map<string,string>").alias("properties"), *rest
    )
    return entities, relations


_RAW = """raw AS (SELECT 'u' || (user_id % 40) AS extraction, event_id AS seq, CASE
  WHEN event_id % 13 = 0 THEN ' ' ELSE event_type || '-' || (event_id % 97) END AS name, event_type,
  CASE event_type WHEN 'click' THEN 'Person' WHEN 'view' THEN 'Organization' WHEN 'purchase' THEN 'Reference'
  WHEN 'signup' THEN 'Document' ELSE CASE WHEN event_id % 2 = 0 THEN 'bug.report' ELSE 'Some Type' END END AS label,
  CAST((event_id % 10) / 10 AS DOUBLE) AS confidence, 's' || (event_id % 5) AS source_text FROM events),
good AS (SELECT *, CASE WHEN label = 'Document' THEN 'D' || (seq % 29) WHEN label = 'Reference'
  AND seq % 3 = 0 THEN 'R' || (seq % 53) ELSE name END AS key FROM raw WHERE trim(name) <> '' AND label NOT IN ('bug.report', 'Some Type')),
rel AS (SELECT 'u' || (user_id % 40) AS extraction, event_id AS seq, event_type || '-' || (event_id % 97) AS source,
  event_type || '-' || (event_id * 7 % 97) AS target, CAST((event_id % 10) / 10 AS DOUBLE) AS confidence,
  's' || (event_id % 5) AS source_text, event_id % 4 = 0 AS blank FROM events),
known AS (SELECT extraction, name, arg_max(label, seq) AS label, arg_max(key, seq) AS key FROM good GROUP BY extraction, name),
placed AS (SELECT rel.*, a.label AS src_label, a.key AS src_key, b.label AS dst_label, b.key AS dst_key FROM rel
  JOIN known a ON a.extraction = rel.extraction AND a.name = source JOIN known b ON b.extraction = rel.extraction AND b.name = target WHERE NOT blank)"""


@register(f"""WITH {_RAW}, p AS (
  SELECT label, key, seq, CASE label WHEN 'Document' THEN 'doc_id' WHEN 'Reference' THEN 'value' ELSE 'name' END AS property, key AS value FROM good
  UNION ALL SELECT label, key, seq, '_confidence', CAST(confidence AS VARCHAR) FROM good UNION ALL SELECT label, key, seq, '_source_text', source_text FROM good
  UNION ALL SELECT label, key, seq, '_extraction_method', 'llm' FROM good UNION ALL SELECT label, key, seq, 'domain', 'd' || (seq % 7)
  FROM good WHERE label = 'Organization')
SELECT label, key, property, arg_max(value, seq) AS value FROM p GROUP BY label, key, property""")
def kg_import_nodes(spark, sf):
    return knowledge.imported_properties(_raw(spark, sf)[0])


@register(
    f"WITH {_RAW} SELECT src_label, src_key, 'RELATED_TO' AS rel_type, dst_label, dst_key, arg_max(confidence, seq) AS confidence, "
    f"arg_max(source_text, seq) AS source_text FROM placed GROUP BY ALL"
)
def kg_import_edges(spark, sf):
    entities, relations = _raw(spark, sf)
    return knowledge.imported_edges(relations, entities)


@register(f"""WITH {_RAW} SELECT (SELECT count(DISTINCT extraction) FROM raw) AS documents_processed, (SELECT count(*)
  FROM good) AS entities_created, (SELECT count(*) FROM raw) - (SELECT count(*) FROM good) AS entities_failed,
  (SELECT count(*) FROM placed) AS relations_created, (SELECT count(*) FROM rel WHERE blank) AS relations_failed""")
def kg_import_stats(spark, sf):
    entities, relations = _raw(spark, sf)
    return knowledge.import_statistics(relations, entities)


@register(
    f"WITH {_RAW}, h AS (SELECT * FROM raw WHERE label IN ('Person', 'Organization')) SELECT extraction, count(*) AS n, arg_min(name, seq) AS "
    f"first, arg_max(name, seq) AS last FROM h GROUP BY extraction"
)
def kg_graph_format(spark, sf):
    entities = _raw(spark, sf)[0]
    some = knowledge.of_type(entities, "Person").unionByName(knowledge.of_type(entities, "Organization"))
    return knowledge.graph_format(some).select(
        "extraction", F.size("entities").cast("long").alias("n"), F.col("entities")[0]["name"].alias("first"),
        F.element_at("entities", -1)["name"].alias("last")
    )


@register(f"""WITH {_RAW}, m AS (SELECT label AS type, CASE WHEN label IN ('bug.report', 'Some Type') THEN 'unknown'
  WHEN label = 'Document' THEN 'title' WHEN label = 'Reference' AND seq % 3 = 0 THEN ''
  WHEN label = 'Reference' THEN 'value' ELSE 'name' END AS missing FROM raw)
SELECT type, missing, count(*) AS n FROM m GROUP BY type, missing""")
def kg_property_problems(spark, sf):
    found = knowledge.property_problems(_raw(spark, sf)[0])
    return found.groupBy("type", F.coalesce(F.array_join("missing", ","), F.lit("unknown")).alias("missing")).agg(F.count("*").alias("n"))


@register(f"WITH {_RAW} SELECT extraction, seq FROM raw WHERE confidence >= 0.7")
def confident_entities(spark, sf):
    return knowledge.confident(_raw(spark, sf)[0]).select("extraction", "seq")


# ---- look-ups and integrity -----------------------------------------------------------------------------------

_N, _E, _R = D.NODES_SQL, D.EDGES_SQL, D.RAW_EDGES_SQL


@register(f"""WITH {_N} SELECT * FROM (SELECT 'label' AS asked, label, key FROM nodes WHERE label = 'Person' ORDER BY key LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'value', label, key FROM nodes WHERE prop = 'untitled' ORDER BY label, key LIMIT 25)
UNION ALL SELECT * FROM (SELECT 'named', label, key FROM nodes WHERE label = 'Location' AND name <> '')
UNION ALL SELECT * FROM (SELECT 'label_of', label, NULL FROM nodes WHERE label <> 'Document' AND prop = (SELECT min(n_name) FROM nation
  WHERE n_nationkey = 3) ORDER BY label, key LIMIT 1)""")
def kg_search(spark, sf):
    n = D.nodes(spark, sf)
    name = D.table(spark, sf, "nation").where("n_nationkey = 3").first().n_name
    parts = [
        knowledge.search_nodes(n, label="Person", limit=10).select(F.lit("label").alias("asked"), "label", "key"),
        knowledge.search_nodes(n, name="title", value="untitled", limit=25).select(F.lit("value").alias("asked"), "label", "key"),
        knowledge.nodes_of_label(n, "Location").select(F.lit("named").alias("asked"), "label", "key"),
        knowledge.label_of(n, name).select(F.lit("label_of").alias("asked"), "label", F.lit(None).cast("string").alias("key")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("SELECT 'Person' AS label, 'c' || o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def kg_key_violations(spark, sf):
    rows = D.table(spark, sf, "orders").select(F.lit("Person").alias("label"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"))
    return knowledge.key_violations(rows)


@register(f"""WITH {_N}, {_E}, s AS (SELECT label, key, coalesce(name, key) AS shown FROM nodes),
dup AS (SELECT count(*) AS n FROM (SELECT a.shown, rel_type, b.shown FROM raw_edges JOIN s a ON a.label = src_label AND a.key = src_key
  JOIN s b ON b.label = dst_label AND b.key = dst_key GROUP BY ALL HAVING count(*) > 1)),
orphan AS (SELECT count(*) AS n FROM nodes ANTI JOIN (SELECT src_label AS label, src_key AS key FROM edges UNION ALL SELECT dst_label,
  dst_key FROM edges) USING (label, key)),
frag AS (SELECT count(*) AS n FROM (SELECT label, lower(trim(name)) FROM nodes WHERE trim(name) <> '' GROUP BY ALL HAVING count(*) > 1)),
t AS (SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM raw_edges) AS total_relations, (SELECT n
  FROM orphan) AS orphan_nodes, (SELECT n FROM dup) AS duplicate_relations,
  (SELECT count(*) FROM nodes WHERE prop IS NULL) AS schema_violations, 0 AS invalid_predicates, (SELECT count(*) FROM nodes
  WHERE source_text IS NULL) AS missing_provenance, (SELECT n FROM frag) AS fragmented_entities)
SELECT *, round(orphan_nodes / total_nodes, 6) AS orphan_ratio, round(duplicate_relations / total_relations, 6) AS duplicate_ratio,
  CAST(0 AS DOUBLE) AS invalid_predicate_ratio, round(missing_provenance / total_nodes, 6) AS missing_provenance_ratio FROM t""")
def kg_integrity_report(spark, sf):
    return graph.integrity_report(D.nodes(spark, sf), D.raw_edges(spark, sf))


@register()
def canon_plan(spark, sf):
    v = D.variants(spark, sf)
    return graph.canonicalize(v, D.edges(spark, sf))[0]
