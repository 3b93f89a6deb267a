"""Commands: ``python -m quire COMMAND ...``. Every command prints the rows of its result as JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine
from .functions.splitter import chunk_pages
from .functions.text import pick_for_index
from .operators import annotations, evaluation, graph, index, knowledge, pages
from .sources import files
from .streaming.ingest import ingest_results


def _chunks(spark: SparkSession, results: str) -> DataFrame:
    page = files.result_pages(files.processed_results(spark, results))
    return chunk_pages(page.select("document_id", "page_number", pick_for_index(F.col("native.text"), F.col("ocr.text")).alias("text")))


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def ingest(spark, a):
    return spark.createDataFrame([(ingest_results(spark, a.results, f"{a.to}/pages", f"{a.to}/checkpoint"),)], "files long")


def build_index(spark, a):
    done = index.build_index(_chunks(spark, a.results), a.to, force=a.force)
    return index.index_statistics(index.load_index(spark, a.to)["chunks"]).withColumn("built", F.lit(done))


def statistics(spark, a):
    return index.index_statistics(index.load_index(spark, a.index)["chunks"])


def query(spark, a):
    asked = spark.createDataFrame(list(enumerate(a.text)), "query_id long, text string")
    return engine.Engine(index.load_index(spark, a.index), k=a.top).retrieve(asked).orderBy("query_id", "rank")


def graph_import(spark, a):
    entities, relations = files.extraction_rows(files.extractions(spark, a.extractions))
    knowledge.imported_nodes(entities).write.mode("overwrite").parquet(f"{a.to}/nodes")
    knowledge.imported_edges(relations, entities).write.mode("overwrite").parquet(f"{a.to}/edges")
    return knowledge.import_statistics(relations, entities)


def graph_extract(spark, a):
    text = files.text_files(spark, a.texts).withColumnRenamed("document_id", "extraction")
    made = engine.build_graph(text.withColumn("file", F.col("extraction")), engine.by_rules)
    made["nodes"].write.mode("overwrite").parquet(f"{a.to}/nodes")
    made["edges"].write.mode("overwrite").parquet(f"{a.to}/edges")
    return made["statistics"]


def graph_stats(spark, a):
    return graph.largest_first(graph.stats(*_graph(spark, a.graph)))


def graph_integrity(spark, a):
    nodes, edges = _graph(spark, a.graph)
    return graph.integrity_report(nodes.withColumn("source_text", F.col("props")["_source_text"]), edges)


def graph_canonicalize(spark, a):
    plan, nodes, edges = graph.canonicalize(*_graph(spark, a.graph), a.threshold, a.label)
    if not a.dry_run:
        nodes.write.mode("overwrite").parquet(f"{a.to}/nodes")
        edges.write.mode("overwrite").parquet(f"{a.to}/edges")
    return plan


def entity_report(spark, a):
    schema = (
        "document_id STRING, page_number INT, timestamp STRING, "
        "entity_annotations ARRAY<STRUCT<entity_type STRING, judgment STRING, is_hallucinated BOOLEAN>>, "
        "relation_annotations ARRAY<STRUCT<relation_type STRING, judgment STRING, is_hallucinated BOOLEAN>>, "
        "missing_entities ARRAY<STRUCT<name STRING, entity_type STRING>>, missing_relations ARRAY<STRUCT<source STRING, target STRING, relation_type STRING>>"
    )
    return annotations.store_statistics(annotations.with_judgment_metrics(files.annotations(spark, a.store, schema)))


def evaluate(spark, a):
    read = lambda path: files.text_files(spark, path).withColumn("page_number", F.lit(1))
    return pages.evaluate_predictions(read(a.predicted), read(a.truth))


def compare(spark, a):
    return evaluation.compare_methods(spark.read.json(a.results))


COMMANDS = {
    "ingest": (ingest, ["results", "--to"]),
    "index": (build_index, ["results", "--to", "--force"]),
    "stats": (statistics, ["--index"]),
    "query": (query, ["text+", "--index", "--top"]),
    "graph-import": (graph_import, ["extractions", "--to"]),
    "graph-extract": (graph_extract, ["texts", "--to"]),
    "graph-stats": (graph_stats, ["graph"]),
    "graph-integrity": (graph_integrity, ["graph"]),
    "graph-canonicalize": (graph_canonicalize, ["graph", "--to", "--threshold", "--label+", "--dry-run"]),
    "entity-report": (entity_report, ["store"]),
    "evaluate": (evaluate, ["predicted", "truth"]),
    "compare": (compare, ["results"]),
}
_FLAGS, _KINDS = {"--force", "--dry-run"}, {"--top": (int, 8), "--threshold": (float, 0.85)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quire")
    each = out.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        own = each.add_parser(name)
        for x in arguments:
            plain = x.rstrip("+")
            if plain in _FLAGS:
                own.add_argument(plain, action="store_true")
            elif x.endswith("+"):
                own.add_argument(plain, nargs="+")
            elif plain in _KINDS:
                own.add_argument(plain, type=_KINDS[plain][0], default=_KINDS[plain][1])
            else:
                own.add_argument(plain, **({"required": plain != "--to" or name != "graph-canonicalize"} if plain.startswith("--") else {}))
    return out


def main(arguments: list[str], spark: SparkSession | None = None) -> list[str]:
    a = parser().parse_args(arguments)
    if a.command == "graph-canonicalize" and not a.dry_run and not a.to:
        raise SystemExit("graph-canonicalize needs --to or --dry-run")
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    lines = [r.json for r in COMMANDS[a.command][0](spark, a).select(F.to_json(F.struct("*")).alias("json")).toLocalIterator()]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main(sys.argv[1:])
