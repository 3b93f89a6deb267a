"""The property-graph schema: entity and relation types and the aliases that extractors emit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EntityType:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    key: str = "name"


@dataclass(frozen=True)
class RelationType:
    name: str
    source: str
    target: str


# Entity types with their properties, relation types with their ends, and type aliases.
ENTITIES = {
    e.name: e
    for e in (
        EntityType("Document", ("doc_id", "title"), ("document_type", "language", "page_count", "source_tracker", "source_bug_id", "summary"), "doc_id"),
        EntityType("Person", ("name",), ("email", "role", "title")),
        EntityType("Organization", ("name",), ("type", "address", "domain")),
        EntityType("Technology", ("name",), ("type", "version", "vendor")),
        EntityType("Topic", ("name",), ("description", "category")),
        EntityType("Reference", ("value",), ("type", "issuer"), "value"),
        EntityType("Location", ("name",), ("address", "city", "country")),
    )
}
RELATIONS = {
    r.name: r
    for r in (
        RelationType("MENTIONS_PERSON", "Document", "Person"),
        RelationType("MENTIONS_ORG", "Document", "Organization"),
        RelationType("MENTIONS_TECH", "Document", "Technology"),
        RelationType("COVERS_TOPIC", "Document", "Topic"),
        RelationType("HAS_REFERENCE", "Document", "Reference"),
        RelationType("HAS_LOCATION", "Document", "Location"),
        RelationType("AFFILIATED_WITH", "Person", "Organization"),
        RelationType("RELATED_TO", "Document", "Document"),
        RelationType("LOCATED_AT", "Organization", "Location"),
    )
}
TYPE_ALIASES = {
    "Location": ("LOCATION", "City", "Country", "Building", "Office", "Address", "Region"),
    "Organization": ("ORGANIZATION", "Bank", "Company", "Institution"),
    "Person": ("PERSON",),
    "Reference": ("Date", "DATE", "Number", "MonetaryValue", "Quantity", "Dimension", "Certificate", "Currency", "ID"),
    "Technology": ("Website", "Software", "Hardware", "Product", "PRODUCT"),
    "Topic": ("Material", "Book", "Form", "Process", "Concept", "Category"),
}
RELATION_ALIASES = {"RELATED_TO": ("MENTIONS", "RELATED")}
# Named-entity labels, document relations by type and prepositions of the classical extractor.
NER_TYPES = {
    "Person": ("PERSON",),
    "Organization": ("ORG",),
    "Location": ("GPE", "LOC"),
    "Technology": ("PRODUCT",),
    "Reference": ("DATE", "MONEY", "CARDINAL", "ORDINAL"),
}
DOCUMENT_RELATION = {r.target: r.name for r in RELATIONS.values() if r.source == "Document" and r.target != "Document"}
PREPOSITION_RELATION = {"of": "AFFILIATED_WITH", "at": "AFFILIATED_WITH", "from": "AFFILIATED_WITH", "for": "AFFILIATED_WITH", "in": "HAS_LOCATION"}


def entity_frame(spark: SparkSession) -> DataFrame:
    """(label, key, required, optional): one row an entity type."""
    return spark.createDataFrame([(e.name, e.key, list(e.required), list(e.optional)) for e in ENTITIES.values()], "label string, key string, required array<string>, optional array<string>")


def relation_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.name, r.source, r.target) for r in RELATIONS.values()], "rel_type string, source string, target string")


def prompt_types() -> str:
    """Entity and relation types as the text an extraction prompt lists."""
    own = [f"- {e.name}: required {', '.join(e.required)}; optional {', '.join(e.optional)}" for e in ENTITIES.values()]
    return "\n".join([*own, *(f"- {r.name}: {r.source} -> {r.target}" for r in RELATIONS.values())])
