"""The engine as one object: an index, a graph and a generator, put together from a configuration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import extraction, graph, index, knowledge, prompts, retrieval
from .plugins import Generator, generate_answers, stream_answer


@dataclass
class Engine:
    """Retrieval and answers over a loaded index (``index.load_index``) and, if given, a graph of nodes and edges.

    ``list_k`` rows of each list are fused into ``k``. ``embedded`` turns queries (query_id, text) into (query_id, v); without it,
    or without vectors in the index, there is no vector list.
    """

    tables: dict[str, DataFrame]
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    generator: Generator | None = None
    embedded: object = None
    list_k: int = 10
    k: int = 8
    rrf_k: int = retrieval.RRF_K
    turns: int = 3
    hops: int = 2

    @classmethod
    def from_config(cls, spark: SparkSession, config: dict, **given) -> Engine:
        """An engine of a configuration with index.folder and, under retrieval, top_k, final_top_k, rrf_k and max_hops; all but the folder may lack."""
        found = config.get("retrieval") or {}
        names = {"list_k": "top_k", "k": "final_top_k", "rrf_k": "rrf_k", "hops": "max_hops"}
        own = {name: int(found[key]) for name, key in names.items() if found.get(key) is not None}
        return cls(index.load_index(spark, config["index"]["folder"]), **{**own, **given})

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, id, score, source): the fused list of each query (query_id, text). Lists that fail to plan are empty."""
        lists = {"bm25": lambda: index.search_index(self.tables, queries, self.list_k)}
        if "vectors" in self.tables and self.embedded is not None:
            lists["vector"] = lambda: self._vector_list(self.embedded(queries))
        if self.nodes is not None and self.edges is not None:
            lists["graph"] = lambda: graph.graph_retrieve(
                queries, self.nodes, self.edges, self.list_k, self.hops
            ).withColumn("id", F.concat(F.lit("graph_"), "id"))
        return retrieval.hybrid(lists, self.k, self.rrf_k)

    def _vector_list(self, queries: DataFrame) -> DataFrame:
        # The vector search takes numbers as ids: places in the order of chunk ids stand in.
        numbered = self.tables["vectors"].withColumn("n", F.xxhash64("id"))
        asked = queries.withColumn("q", F.xxhash64(F.lit("query"), F.col("query_id").cast("string")))
        found = retrieval.cosine_top_k(numbered.select(F.col("n").alias("id"), "v"), asked.select(F.col("q").alias("query_id"), "v"), self.list_k)
        named = found.join(
            asked.select(F.col("q"), F.col("query_id").alias("of")), F.col("query_id") == F.col("q")
        ).join(numbered.select("n", F.col("id").alias("chunk")), F.col("id") == F.col("n"))
        return named.select(F.col("of").alias("query_id"), "rank", F.col("chunk").alias("id"), "score")

    def prompts(self, queries: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(query_id, prompt): the context that is found, the last turns of ``history`` (conv_id = query_id, turn, role, text) and the question."""
        found = self.retrieve(queries)
        texts = self.tables["chunks"].select(F.col("chunk_id").alias("id"), "document_id", "text")
        context = prompts.format_context(
            found.join(texts, "id", "left").select(
                "query_id", "rank", "source", F.coalesce("document_id", "id").alias("document_id"), F.coalesce("text", "id").alias("text")
            )
        )
        rows = queries.join(context, "query_id", "left")
        if history is None:
            rows = rows.withColumn("history", F.lit(None).cast("string"))
        else:
            rows = rows.join(prompts.history_block(history, self.turns).withColumnRenamed("conv_id", "query_id"), "query_id", "left")
        return rows.select("query_id", prompts.build_prompt(F.col("history"), F.col("context"), F.col("text")).alias("prompt"))

    def answer(self, queries: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(query_id, prompt, answer, error) of a batch of queries."""
        if self.generator is None:
            raise ValueError("the engine has no generator")
        return generate_answers(self.prompts(queries, history), self.generator)

    def stream(self, query: str, history: DataFrame | None = None) -> Iterator[dict]:
        """Events of the answer to one question."""
        if self.generator is None:
            raise ValueError("the engine has no generator")
        spark = self.tables["chunks"].sparkSession
        prompt = self.prompts(spark.createDataFrame([(0, query)], "query_id long, text string"), history).first().prompt
        yield from stream_answer(prompt, self.generator)


def build_graph(
    docs: DataFrame, extractor, done: DataFrame | None = None, share: tuple[int, int] | None = None, metadata: DataFrame | None = None
) -> dict[str, DataFrame]:
    """nodes, edges and statistics of a graph from pages (extraction, text, file) by an extractor of (entities, relations).

    Files among ``done`` (file_name, state) that are completed or skipped are left out, failed ones run again; ``share`` is
    (index, total) of this run's part of the files. ``metadata`` (extraction, extra) completes Documents.
    """
    if done is not None:
        docs = docs.join(done.where("state in ('completed', 'skipped')").select(F.col("file_name").alias("file")), "file", "left_anti")
    if share is not None:
        docs = docs.where(F.pmod(F.xxhash64("file"), F.lit(share[1])) == share[0])
    entities, relations = extractor(docs.select("extraction", "text"))
    if metadata is not None:
        entities = knowledge.with_document_metadata(entities, metadata)
    order = F.struct("extraction", "ord")
    entities, relations = entities.withColumn("seq", order), relations.withColumn("seq", order)
    nodes = knowledge.imported_nodes(entities)
    return {"nodes": nodes, "edges": knowledge.imported_edges(relations, entities), "statistics": knowledge.import_statistics(relations, entities)}


def by_rules(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The offline extractor: entities and relations by rules."""
    return knowledge.extract(docs, docs.select("extraction", F.lit(None).cast("string").alias("answer")))


def both(*extractors):
    """An extractor that unites what several find, each in the order given."""

    def run(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = [x(docs) for x in extractors]
        out = []
        for side in (0, 1):
            union = found[0][side]
            for other in found[1:]:
                union = union.unionByName(other[side])
            out.append(union)
        return out[0], out[1]

    return run


def process_files(files: DataFrame, parse, method: str = "hybrid", recognise=None, threshold: float = extraction.NATIVE_THRESHOLD) -> DataFrame:
    """One row a document of files (path, length, content): the plan, the text by the better method and why it was skipped or failed.

    ``parse`` makes pages of bytes; ``recognise`` (bytes to text), if given, runs only on documents whose plan asks for it. Files
    that are too large are not read, ones of too many pages are not recognised.
    """
    from .operators import pages as P
    from .sources import files as S

    sized = files.withColumn("skipped", extraction.file_guard(F.col("length"), F.lit(0)))
    small = sized.where("skipped is null")
    parsed = S.native_pages(S.parse_documents(small, parse))
    rows = parsed.select(F.col("path").alias("document_id"), "page_number", F.col("text").alias("native"), F.lit("").alias("ocr"), "coverage", "error")
    native = P.document_coverage(rows.where("error is null")).join(P.export_text(rows.where("error is null"), 1 << 30), "document_id")
    failed = rows.where("error is not null").select("document_id", "error")
    each = small.select(F.col("path").alias("document_id"), "content").join(native, "document_id", "left").join(failed, "document_id", "left")
    each = each.withColumn("skipped", extraction.file_guard(F.lit(0), F.col("total_pages")))
    each = each.withColumn("plan", F.when(F.col("skipped").isNull(), extraction.batch_plan(F.lit(method), F.col("overall_coverage"), threshold)))
    read = S.recognise(
        each.withColumn("image", F.when(F.col("plan") == "run_ocr", F.col("content"))), recognise
    ) if recognise else each.withColumns({"ocr_text": F.lit(None).cast("string"), "ocr_error": F.lit(None).cast("string")})
    used = extraction.route(F.col("error").isNull() & F.col("text").isNotNull(), F.col("overall_coverage"), F.col("ocr_text").isNotNull(), threshold)
    done = read.select(
        "document_id", "total_pages", "overall_coverage", "skipped", "plan", F.when(F.col("skipped").isNull(), used).alias("method"),
        F.when(used == "ocr", F.col("ocr_text")).otherwise(F.col("text")).alias("text"),
        F.coalesce("error", F.when(F.col("plan") == "run_ocr", F.col("ocr_error"))).alias("error")
    )
    large = sized.where("skipped is not null").select(F.col("path").alias("document_id"), "skipped")
    return done.unionByName(large, allowMissingColumns=True)


def image_window(pages: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pages of each document, by number."""
    w = Window.partitionBy("document_id").orderBy("page_number")
    return pages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
