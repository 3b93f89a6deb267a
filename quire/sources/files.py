"""File sources and sinks. Formats that need a parser or a model take it as a plain function."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X

PAGE = (
    "STRUCT<page_number INT, native STRUCT<text STRING, tables ARRAY<ARRAY<ARRAY<STRING>>>, coverage DOUBLE, word_count INT, char_count "
    "INT, success BOOLEAN, error STRING, processing_time_ms INT>, ocr STRUCT<text STRING, success BOOLEAN, error STRING, image_path "
    "STRING, processing_time_ms INT>>"
)
RESULT = (
    f"source_pdf STRING, total_pages INT, pages ARRAY<{PAGE}>, summary STRUCT<native_success_rate STRING, ocr_success_rate STRING, "
    f"average_native_coverage DOUBLE, ocr_failed_pages ARRAY<INT>, native_failed_pages ARRAY<INT>, total_processing_time_seconds DOUBLE, "
    f"extracted_at STRING>"
)
ENTITY = "STRUCT<name STRING, type STRING, properties MAP<STRING,STRING>, confidence DOUBLE, source_text STRING>"
RELATION = "STRUCT<source STRING, target STRING, type STRING, properties MAP<STRING,STRING>, confidence DOUBLE, source_text STRING>"
EXTRACTION = f"source_document STRING, entities ARRAY<{ENTITY}>, relations ARRAY<{RELATION}>, processing_metadata MAP<STRING,STRING>"
EVAL_QUERY = (
    "query_id STRING, question STRING, relevant_document_ids ARRAY<STRING>, relevant_chunk_ids ARRAY<STRING>, expected_entities "
    "ARRAY<STRING>, category STRING, difficulty STRING, notes STRING"
)


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(path, modificationTime, length, content); the content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def _json(spark: SparkSession, schema: str, paths: str | list[str]) -> DataFrame:
    df = spark.read.schema(f"{schema}, _corrupt_record STRING").option("multiLine", "true").option("mode", "PERMISSIVE").json(paths)
    return df.withColumn("file", F.col("_metadata.file_path"))


def result_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Result documents with stem and file; files that do not parse are left out."""
    df = _json(spark, RESULT, paths).where("_corrupt_record is null").drop("_corrupt_record")
    return df.withColumn("stem", F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(_results)?\.json$", ""))


def corrupt_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file): those that do not parse."""
    every = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"))
    # The reader refuses plans that use the corrupt-record column alone, hence the size.
    good = result_documents(spark, paths).where(F.coalesce(F.size("pages"), F.lit(-1)) >= -1).select("file")
    return every.join(good, "file", "left_anti")


def processed_results(spark: SparkSession, root: str) -> DataFrame:
    """Result documents under ``root`` in any layout (batch/results, batch/type/results or results) with ``source_dir``, the folder above."""
    df = spark.read.schema(f"{RESULT}, _corrupt_record STRING").option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_results.json").json(root)
    parts = F.split("file", "/")
    df = df.withColumn("file", F.col("_metadata.file_path")).where("_corrupt_record is null").drop("_corrupt_record")
    above = F.when(F.element_at(parts, -2) == "results", F.element_at(parts, -3)).otherwise(F.element_at(parts, -2))
    return df.withColumn("stem", F.regexp_replace(F.element_at(parts, -1), r"_results\.json$", "")).withColumn("source_dir", above)


def result_pages(documents: DataFrame) -> DataFrame:
    """(document_id, source_pdf, pos, page_number, native, ocr), pos from 1 in file order."""
    return documents.select(
        F.col("stem").alias("document_id"), "source_pdf", F.posexplode("pages").alias("p", "page")
    ).select("document_id", "source_pdf", (F.col("p") + 1).alias("pos"), "page.*")


def combined_text(documents: DataFrame) -> DataFrame:
    """(document_id, text, tables): native texts joined by blank lines, all tables in order."""
    texts = F.transform("pages", lambda p: F.coalesce(p["native"]["text"], F.lit("")))
    return documents.select(
        F.col("stem").alias("document_id"), F.array_join(texts, "\n\n").alias("text"),
        F.flatten(F.transform("pages", lambda p: F.coalesce(p["native"]["tables"], F.array()))).alias("tables")
    )


def nonempty_tables(tables):
    """Tables of which some row has a cell."""
    return F.filter(tables, lambda t: F.exists(t, lambda row: F.exists(row, lambda c: c.isNotNull() & (c != ""))))


def extractions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ord, source_document, entities, relations) from files that hold one extraction, or a list under ``extractions`` or on top."""
    inner = "STRUCT<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(EXTRACTION)) + ">"
    df = _json(spark, f"{EXTRACTION}, extractions ARRAY<{inner}>", paths).where("_corrupt_record is null")
    own = F.array(F.struct("source_document", "entities", "relations", "processing_metadata"))
    return df.select("file", F.posexplode(F.coalesce("extractions", own)).alias("ord", "x")).select("file", "ord", "x.*")


def extraction_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) as rows of read extractions, each with ``seq``, its place in the order of files, extractions and items."""
    own = F.coalesce("source_document", F.concat_ws("#", "file", F.col("ord").cast("string")))
    out = []
    for field, ends in (("entities", ["name", "type"]), ("relations", ["source", "target", "type"])):
        each = found.select("file", own.alias("extraction"), F.col("ord").alias("at"), F.posexplode(field).alias("ord", "x"))
        rest = [
            F.coalesce("x.properties", F.create_map().cast("map<string,string>")).alias("properties"),
            F.coalesce("x.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("x.source_text", F.lit("")).alias("source_text")
        ]
        out.append(each.select("file", "extraction", "ord", *[F.col(f"x.{e}").alias(e) for e in ends], *rest, F.struct("file", "at", "ord").alias("seq")))
    return out[0], out[1]


def extraction_statistics(found: DataFrame) -> DataFrame:
    """(file, extractions, entities, relations) of read extractions."""
    size = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0))
    return found.groupBy("file").agg(F.count("*").alias("extractions"), size("entities").alias("entities"), size("relations").alias("relations"))


def annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, ...) of a store file that maps keys to annotations of ``schema``; the keys only name the rows."""
    df = spark.read.schema("value STRING").text(path, wholetext=True)
    one = "STRUCT<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema)) + ">"
    return df.select(F.explode(F.from_json("value", f"MAP<STRING, {one}>")).alias("key", "a")).select("key", "a.*")


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_QUERY).option("multiLine", "true").json(path)


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(document_id, text), one row a file."""
    df = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(folder)
    return df.select(
        F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "").alias("document_id"),
        F.col("value").alias("text")
    )


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(path): the lines that are not blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def parse_documents(
    files: DataFrame, parse: Callable[[bytes], list[dict]],
    schema: str = "page_number int, text string, tables array<array<array<string>>>, width double, height double"
) -> DataFrame:
    """Pages of binary files by an injected parser; a file that fails gives one row with its error."""
    kinds = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows, error = parse(content.as_py()), None
                except Exception as e:  # one bad file is a row, not a failed job
                    rows, error = [{}], str(e)
                columns = [
                    pa.array([path] * len(rows)), *(pa.array([r.get(f.name) for r in rows], to_arrow_type(f.dataType)) for f in kinds),
                    pa.array([error] * len(rows), pa.string())
                ]
                yield pa.RecordBatch.from_arrays(columns, ["path", *kinds.names, "error"])

    return files.select("path", "content").mapInArrow(run, f"path string, {schema}, error string")


def native_pages(parsed: DataFrame) -> DataFrame:
    """Parsed pages (path, page_number, text, tables, width, height, error) with word_count, char_count and coverage, and only tables with a cell."""
    text = F.coalesce("text", F.lit(""))
    counts = {"text": text, "tables": nonempty_tables(F.coalesce("tables", F.array())), "word_count": X.word_count(text), "char_count": F.length(text)}
    return parsed.withColumns(counts).withColumn(
        "coverage", X.page_coverage("char_count", F.coalesce("width", F.lit(0.0)), F.coalesce("height", F.lit(0.0)))
    ).drop("width", "height")


def page_counts(files: DataFrame, count: Callable[[bytes], int]) -> DataFrame:
    """(path, total_pages, error) by an injected counter; a file that cannot be counted has an error and no count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path, int(count(bytes(content))), None))
                except Exception as e:  # as above
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "total_pages", "error"]).astype({"total_pages": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, total_pages int, error string")


def page_images(files: DataFrame, render: Callable[[bytes, int], bytes], first: int = 1, last: int | None = None) -> DataFrame:
    """(path, page_number, image_name, image, error) of files (path, content, total_pages): pages ``first`` to ``last``, one at a time.

    A page that cannot be rendered has an error and no image; a file without pages gives no rows.
    """
    end = F.col("total_pages") if last is None else F.least("total_pages", F.lit(last))
    wanted = files.where(end >= first).select("path", "content", F.explode(F.sequence(F.lit(first), end)).alias("page_number"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content, page in zip(pdf["path"], pdf["content"], pdf["page_number"], strict=True):
                image = error = None
                try:
                    image = render(bytes(content), int(page))
                except Exception as e:  # as above
                    error = str(e)
                yield pd.DataFrame([(path, page, image, error)], columns=["path", "page_number", "image", "error"])

    drawn = wanted.mapInPandas(run, "path string, page_number int, image binary, error string")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return drawn.select("path", "page_number", F.format_string("%s_page_%04d.png", stem, "page_number").alias("image_name"), "image", "error")


def recognise(images: DataFrame, read: Callable[[str], str]) -> DataFrame:
    """Images with ocr_text and ocr_error, by an injected reader of base64 images, which may retry (``plugins.retry``)."""
    import base64

    @F.pandas_udf("text string, error string")
    def both(content: pd.Series) -> pd.DataFrame:
        rows = []
        for image in content:
            try:
                rows.append((None if image is None else read(base64.b64encode(image).decode()), "no image" if image is None else None))
            except Exception as e:  # as above
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["text", "error"])

    return images.withColumn("__o", both("image")).select(*images.columns, F.col("__o.text").alias("ocr_text"), F.col("__o.error").alias("ocr_error"))


def write_results(documents: DataFrame, folder: str, as_json: bool = False) -> None:
    writer = documents.write.mode("overwrite")
    writer.json(folder) if as_json else writer.parquet(folder)


def write_extractions(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").partitionBy("method").parquet(folder)


def write_report(report: DataFrame, folder: str) -> None:
    """A report of few rows as JSON lines in one file."""
    report.coalesce(1).write.mode("overwrite").json(folder)


def write_list(paths: DataFrame, folder: str) -> None:
    """(path) as lines of text, in order."""
    paths.select(F.col("path").alias("value")).orderBy("value").write.mode("overwrite").text(folder)


def expand_env(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` and ``${NAME:-default}`` replaced from the environment."""
    env = dict(os.environ) if env is None else env
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1]) or (m[2] if m[2] is not None else ""), text)


def read_config(text: str, env: dict[str, str] | None = None) -> dict:
    """A configuration of nested ``key: value`` lines and ``- item`` lists, the plain part of YAML, after ``expand_env``.

    Values are numbers, true, false, null or text, which may be quoted; comments start with a hash after white space.
    """
    comment = re.compile(r"""^((?:[^"'#]|"[^"]*"|'[^']*'|(?<=\S)#|["'])*?)(?:(?:^|\s)#.*)?$""")
    lines = [(len(line) - len(line.lstrip()), line.strip()) for raw in expand_env(text, env).splitlines() if (line := comment.match(raw)[1].rstrip()).strip()]

    def value(v: str):
        if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
            return v[1:-1]
        plain = {"true": True, "false": False, "null": None, "~": None, "": None}
        if v.lower() in plain:
            return plain[v.lower()]
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    def block(at: int, depth: int) -> tuple[object, int]:
        out: dict | list = [] if lines[at][1].startswith("- ") else {}
        while at < len(lines) and lines[at][0] == depth:
            content = lines[at][1]
            if isinstance(out, list):
                if not content.startswith("- "):
                    break
                out.append(value(content[2:].strip()))
                at += 1
                continue
            name, _, rest = content.partition(":")
            at += 1
            if rest.strip() or at == len(lines) or lines[at][0] <= depth and not lines[at][1].startswith("- "):
                out[name.strip()] = value(rest.strip())
            else:
                out[name.strip()], at = block(at, lines[at][0])
        return out, at

    return block(0, lines[0][0])[0] if lines else {}
