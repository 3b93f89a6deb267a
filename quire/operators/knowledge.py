"""From model answers to a property graph: answer parsing, import of extractions, filters and look-ups.

Entities are rows (extraction, ord, name, type, properties, confidence, source_text), relations are rows (extraction, ord, source,
target, type, properties, confidence, source_text); ``seq`` is a total order of all rows. Unless an operator says
otherwise, null names and types count as blank, rows that repeat are treated each on its own and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.repair import repair_json
from ..schema import ENTITIES, entity_frame
from . import extraction, graph
from ._durable import durable

_PROPERTIES = "properties MAP<STRING,STRING>, confidence DOUBLE, source_text STRING"
ANSWER = f"entities ARRAY<STRUCT<name STRING, type STRING, {_PROPERTIES}>>, relations ARRAY<STRUCT<source STRING, target STRING, type STRING, {_PROPERTIES}>>"
DEFAULT_CONFIDENCE = 0.5
ENTITY_COLUMNS = ["extraction", "ord", "name", "type", "properties", "confidence", "source_text"]
RELATION_COLUMNS = ["extraction", "ord", "source", "target", "type", "properties", "confidence", "source_text"]


def _blank(c: Column) -> Column:
    return F.coalesce(T.strip(c) == "", F.lit(True))


def _no_properties() -> Column:
    return F.create_map().cast("map<string,string>")


# ---- answers ---------------------------------------------------------------------------------------------


def read_answers(answers: DataFrame) -> DataFrame:
    """(extraction, answer, parsed): model answers (extraction, answer) as structs, null where nothing can be made of one.

    An answer is read as it stands, without thinking blocks and fences, else by its widest braces, else after repair. Only
    answers that no built-in parses reach the UDF. What was read is written, as entities and relations both take it several times.
    """
    plain = durable(answers.withColumn("parsed", extraction.parse_answer("answer", ANSWER)), "answers")
    repaired = F.from_json(repair_json(T.strip_wrappers("answer")), ANSWER)
    rest = durable(plain.where("parsed is null").withColumn("parsed", repaired), "repaired")
    return plain.where("parsed is not null").unionByName(rest)


def _explode(parsed: DataFrame, field: str) -> DataFrame:
    each = parsed.where("parsed is not null").select("extraction", F.posexplode(F.col("parsed")[field]).alias("ord", "x"))
    x = F.col("x")
    common = [
        F.coalesce(x["properties"], _no_properties()).alias("properties"),
        F.coalesce(x["confidence"], F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.coalesce(x["source_text"], F.lit("")).alias("source_text"),
    ]
    ends = ["name", "type"] if field == "entities" else ["source", "target", "type"]
    return each.select("extraction", "ord", *[x[e].alias(e) for e in ends], *common)


def answer_entities(parsed: DataFrame) -> DataFrame:
    """Entities of parsed answers: types mapped to known ones, names cleaned, and one Document for each extraction.

    Blank names and unknown types go. A Document takes the extraction's own name and a ``doc_id``; where no
    entity has that name, a Document is added after the others.
    """
    known = _explode(parsed, "entities").withColumn("type", graph.remap_entity_type("type")).where(F.col("type").isNotNull() & ~_blank(F.col("name")))
    is_document = F.col("type") == "Document"
    has_id = F.coalesce(F.col("properties")["doc_id"], F.lit("")) != ""
    others = F.map_filter("properties", lambda k, v: k != "doc_id")
    own_id = F.map_concat(others, F.create_map(F.lit("doc_id"), F.col("extraction")))
    cleaned = known.withColumns(
        {"name": T.clean_entity_name("name", "type", "extraction"), "properties": F.when(is_document & ~has_id, own_id).otherwise(F.col("properties"))}
    )
    named = cleaned.where(F.col("name") == F.col("extraction")).select("extraction").distinct()
    lacking = parsed.where("parsed is not null").select(
        "extraction", F.greatest(F.size("parsed.entities"), F.lit(0)).alias("ord")
    ).join(named, "extraction", "left_anti")
    title = F.create_map(F.lit("doc_id"), F.col("extraction"), F.lit("title"), F.col("extraction"))
    added = lacking.select(
        "extraction", "ord", F.col("extraction").alias("name"), F.lit("Document").alias("type"), title.alias("properties"),
        F.lit(1.0).alias("confidence"), F.lit("").alias("source_text")
    )
    return cleaned.select(*ENTITY_COLUMNS).unionByName(added)


def answer_relations(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of parsed answers of a known type, both of whose ends are among the entities of their extraction."""
    known = _explode(parsed, "relations").withColumn("type", graph.remap_relation_type("type")).where(F.col("type").isNotNull())
    names = durable(entities.select("extraction", "name").unionByName(parsed.select("extraction", F.col("extraction").alias("name"))), "names")
    for end in ("source", "target"):
        known = known.join(names.withColumnRenamed("name", end), ["extraction", end], "left_semi")
    return known.select(*RELATION_COLUMNS)


def extract(docs: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of ``docs`` (extraction, text): from their answers, or by rules where an answer is missing or unreadable."""
    parsed = read_answers(answers)
    entities = answer_entities(parsed)
    relations = answer_relations(parsed, entities)
    rest = docs.join(parsed.where("parsed is not null").select("extraction"), "extraction", "left_anti")
    ruled = extraction.rule_entities(rest.select(F.col("extraction").alias("doc_id"), "text"))
    kind = F.when(F.col("ord") > 0, F.create_map(F.lit("type"), F.col("kind"))).otherwise(_no_properties())
    own = ruled.select(F.col("doc_id").alias("extraction"), "ord", "name", "type", kind.alias("properties"), "confidence", "source_text")
    links = extraction.rule_relations(ruled).select(
        F.col("doc_id").alias("extraction"), "ord", "source", "target", F.col("rel_type").alias("type"),
        _no_properties().alias("properties"), F.lit(0.6).alias("confidence"), F.lit("").alias("source_text")
    )
    return entities.unionByName(own), relations.unionByName(links)


def tagged_extraction(docs: DataFrame, confidence: tuple[float, float] = (0.7, 0.6)) -> tuple[DataFrame, DataFrame]:
    """Entities and relations from texts that a tagger has read.

    ``docs`` has (extraction, mentions ARRAY<STRUCT<text, label, sentence, first, last>>, tokens ARRAY<STRUCT<i, text, dep, head, sentence>>);
    first and last are the token numbers of a mention. Of a name, without regard to case, the first mention of each
    type counts. Each entity hangs on its document; the subject and object of a root verb are related, and so are the
    head and the object of one of the known prepositions, where both lie in mentions of entities.
    """
    from ..schema import DOCUMENT_RELATION, PREPOSITION_RELATION

    m = F.col("m")
    found = docs.select("extraction", F.posexplode("mentions").alias("ord", "m")).select(
        "extraction", (F.col("ord") + 1).alias("ord"), T.strip(m["text"]).alias("name"), graph.ner_type(m["label"]).alias("type"),
        m["label"].alias("label"), m["sentence"].alias("source_text")
    )
    found = found.where("type is not null and name <> ''")
    first = found.groupBy("extraction", F.lower("name").alias("k"), "type").agg(
        F.min_by(F.struct("ord", "name", "label", "source_text"), "ord").alias("e")
    ).select("extraction", "type", "e.*")
    method = [F.lit("extraction_method"), F.lit("classical")]
    reference = F.when(F.col("type") == "Reference", F.create_map(*method, F.lit("type"), F.col("label"))).otherwise(F.create_map(*method))
    entities = first.select("extraction", "ord", "name", "type", reference.alias("properties"), F.lit(confidence[0]).alias("confidence"), "source_text")
    own = docs.select(
        "extraction", F.lit(0).alias("ord"), F.col("extraction").alias("name"), F.lit("Document").alias("type"),
        F.create_map(*method).alias("properties"), F.lit(1.0).alias("confidence"), F.lit("").alias("source_text")
    )
    links = entities.select(
        "extraction", F.col("ord").cast("long").alias("ord"), F.col("extraction").alias("source"), F.col("name").alias("target"),
        _lookup(F.col("type"), DOCUMENT_RELATION).alias("type"), "source_text"
    ).where("type is not null")

    token = docs.select("extraction", F.explode("tokens").alias("t")).select("extraction", "t.*")
    covering = docs.select("extraction", F.explode("mentions").alias("m")).select(
        "extraction", F.explode(F.sequence("m.first", "m.last")).alias("i"), T.strip(F.col("m.text")).alias("name")
    )
    named = covering.join(entities.select("extraction", "name").distinct(), ["extraction", "name"], "left_semi").dropDuplicates(["extraction", "i"])
    of = lambda side, i: named.select("extraction", F.col("i").alias(i), F.col("name").alias(side))
    root = token.where("dep = 'ROOT'").select("extraction", F.col("i").alias("root"), F.col("sentence").alias("source_text"))
    child = lambda deps, i: token.where(F.col("dep").isin(*deps)).select("extraction", F.col("head").alias("root"), F.col("i").alias(i))
    verbs = root.join(child(["nsubj", "nsubjpass"], "s"), ["extraction", "root"]).join(child(["dobj", "pobj", "attr"], "o"), ["extraction", "root"])
    verbs = verbs.join(of("source", "s"), ["extraction", "s"]).join(of("target", "o"), ["extraction", "o"])
    verbs = verbs.select("extraction", (F.lit(1 << 32) + F.col("root")).alias("ord"), "source", "target", F.lit("RELATED_TO").alias("type"), "source_text")
    prep = token.where("dep = 'prep'").withColumn("type", _lookup(F.lower("text"), PREPOSITION_RELATION)).where("type is not null")
    prep = prep.select("extraction", F.col("i").alias("root"), F.col("head").alias("s"), "type", F.col("sentence").alias("source_text"))
    prep = prep.join(
        child(["pobj", "pcomp"], "o"), ["extraction", "root"]
    ).join(of("source", "s"), ["extraction", "s"]).join(of("target", "o"), ["extraction", "o"])
    prep = prep.select("extraction", (F.lit(1 << 32) + F.col("root")).alias("ord"), "source", "target", "type", "source_text")
    each = links.unionByName(verbs).unionByName(prep)
    once = each.groupBy("extraction", "source", "target", "type").agg(F.min_by(F.struct("ord", "source_text"), "ord").alias("r"))
    relations = once.select(
        "extraction", "r.ord", "source", "target", "type", F.create_map(*method).alias("properties"),
        F.lit(confidence[1]).alias("confidence"), "r.source_text"
    )
    return own.unionByName(entities), relations.select(*RELATION_COLUMNS)


def _lookup(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, to in table.items():
        out = F.when(value == key, F.lit(to)).otherwise(out)
    return out


# ---- import ----------------------------------------------------------------------------------------------


def with_document_metadata(entities: DataFrame, metadata: DataFrame) -> DataFrame:
    """Entities whose Documents have the properties of ``metadata`` (extraction, extra map) that they lack."""
    joined = entities.join(metadata.select("extraction", "extra"), "extraction", "left")
    missing = F.map_filter("extra", lambda k, v: ~F.map_contains_key(F.col("properties"), k))
    filled = F.when((F.col("type") == "Document") & F.col("extra").isNotNull(), F.map_concat("properties", missing)).otherwise(F.col("properties"))
    return joined.withColumn("properties", filled).select(*entities.columns)


def importable(entities: DataFrame) -> DataFrame:
    """Entities with label, key and problem (null for those that are imported)."""
    return entities.withColumns({"label": F.col("type"), "key": graph.node_key("type", "name", "properties"), "problem": graph.entity_problem("name", "type")})


def imported_properties(entities: DataFrame, order: str = "seq") -> DataFrame:
    """(label, key, property, value): of each node's every property the last value that is not null.

    Properties are rows, so a node of many mentions is combined partially before any shuffle.
    """
    good = importable(entities).where("problem is null")
    key_name = F.when(F.col("label") == "Document", "doc_id").when(F.col("label") == "Reference", "value").otherwise("name")
    method = F.coalesce(F.col("properties")["extraction_method"], F.lit("llm"))
    own = F.array(
        _pair(key_name, F.col("key")), _pair(F.lit("_confidence"), F.col("confidence").cast("string")),
        _pair(F.lit("_source_text"), F.col("source_text")), _pair(F.lit("_extraction_method"), method)
    )
    given = F.transform(F.map_entries(F.coalesce("properties", _no_properties())), lambda e: _pair(e["key"], e["value"]))
    rest = F.filter(given, lambda p: ~p["property"].isin("_confidence", "_source_text", "_extraction_method") & (p["property"] != key_name))
    each = good.select(
        "label", "key", F.col(order).alias("at"), F.explode(F.concat(own, rest)).alias("p")
    ).select("label", "key", "at", "p.*").where("value is not null")
    return each.groupBy("label", "key", "property").agg(F.max_by("value", "at").alias("value"))


def _pair(name: Column, value: Column) -> Column:
    return F.struct(name.alias("property"), value.alias("value"))


def imported_nodes(entities: DataFrame, order: str = "seq") -> DataFrame:
    """(label, key, name, props): the nodes with their merged properties as a map."""
    each = imported_properties(entities, order)
    props = F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "value"))))
    return each.groupBy("label", "key").agg(props.alias("props")).select("label", "key", F.col("props")["name"].alias("name"), "props")


def placed_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the labels and keys of both ends; of a name that an extraction repeats the last imported entity counts."""
    good = importable(entities).where("problem is null")
    known = good.groupBy("extraction", "name").agg(F.max_by(F.struct("label", "key"), "ord").alias("n"))
    typed = relations.where(~_blank(F.col("type")))
    for side, end in (("src", "source"), ("dst", "target")):
        typed = typed.join(
            known.select("extraction", F.col("name").alias(end), F.col("n.label").alias(f"{side}_label"), F.col("n.key").alias(f"{side}_key")),
            ["extraction", end]
        )
    return typed.withColumnRenamed("type", "rel_type")


def imported_edges(relations: DataFrame, entities: DataFrame, order: str = "seq") -> DataFrame:
    """(source, type, target, confidence, source_text): one edge for each pair of nodes and type, its last values."""
    rows = placed_relations(relations, entities)
    last = [F.max_by(p, F.when(F.col(p).isNotNull(), F.col(order))).alias(p) for p in ("confidence", "source_text")]
    return rows.groupBy(*graph.EDGE_KEY).agg(*last)


def import_statistics(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: documents, entities and relations that are imported, and those that fail. Relations without an end do neither."""
    e = importable(entities).agg(
        F.count_distinct("extraction").alias("documents_processed"), F.count_if(F.col("problem").isNull()).alias("entities_created"),
        F.count_if(F.col("problem").isNotNull()).alias("entities_failed")
    )
    placed = placed_relations(relations, entities).agg(F.count("*").alias("relations_created"))
    failed = relations.agg(F.count_if(_blank(F.col("type"))).alias("relations_failed"))
    return e.crossJoin(placed).crossJoin(failed)  # one row each


# ---- filters, look-ups and checks --------------------------------------------------------------------------


def confident(rows: DataFrame, least: float = 0.7) -> DataFrame:
    return rows.where(F.col("confidence") >= least)


def of_type(rows: DataFrame, type_: str) -> DataFrame:
    return rows.where(F.col("type") == type_)


def nodes_of_label(nodes: DataFrame, label: str) -> DataFrame:
    """Nodes of a label that have a name."""
    return nodes.where((F.col("label") == label) & (F.coalesce("name", F.lit("")) != ""))


def search_nodes(nodes: DataFrame, label: str | None = None, name: str | None = None, value: str | None = None, limit: int = 100) -> DataFrame:
    """Up to ``limit`` nodes of a label, or with a property of a value, or both, in order of label and key."""
    if label is not None:
        nodes = nodes.where(F.col("label") == label)
    if name is not None:
        nodes = nodes.where(F.col("props")[name] == value)
    return nodes.orderBy("label", "key").limit(limit)


def label_of(nodes: DataFrame, name: str) -> DataFrame:
    """(label): that of one node whose name, doc_id or value property is ``name``; the first by label and key."""
    hit = (F.col("props")["name"] == name) | (F.col("props")["doc_id"] == name) | (F.col("props")["value"] == name)
    return nodes.where(hit).orderBy("label", "key").limit(1).select("label")


def key_violations(nodes: DataFrame) -> DataFrame:
    """(label, key, n): keys that several rows of a label share, as a uniqueness constraint would report."""
    return nodes.groupBy("label", "key").agg(F.count("*").alias("n")).where("n > 1")


def added_nodes(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes and new rows side by side, without merging."""
    return nodes.unionByName(rows, allowMissingColumns=True)


def cleared(nodes: DataFrame, confirm: bool = False) -> DataFrame:
    """No nodes, if confirmed; an error if not."""
    if not confirm:
        raise ValueError("clearing the graph needs confirm=True")
    return nodes.where("false")


def graph_format(entities: DataFrame) -> DataFrame:
    """(extraction, entities): for each extraction its entities in order, without their source texts."""
    each = F.collect_list(F.struct("ord", "name", "type", "properties", "confidence"))
    # Maps have no order, so the sort compares the numbers alone.
    ordered = F.array_sort(each, lambda a, b: F.signum((a["ord"] - b["ord"]).cast("double")).cast("int"))
    return entities.groupBy("extraction").agg(F.transform(ordered, lambda x: x.dropFields("ord")).alias("entities"))


def property_problems(entities: DataFrame) -> DataFrame:
    """Entities with ``missing``: the required properties that they lack, or null where the type is unknown."""
    wanted = F.broadcast(entity_frame(entities.sparkSession).select(F.col("label").alias("type"), "required"))  # a fixed schema
    return entities.join(wanted, "type", "left").withColumn("missing", F.filter("required", lambda p: F.col("properties")[p].isNull())).drop("required")


def schema_valid(types: Column) -> Column:
    """Is a type one of the schema's entity types or relations?"""
    from ..schema import RELATIONS

    return types.isin(*ENTITIES, *RELATIONS)
