"""Context blocks, chat history and prompts for answer generation.

Null texts are treated as empty, results of an unknown source are left out, (query_id, source, rank) and (conv_id, turn) are unique, and
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Section headings.
HEADINGS = {"bm25": "[KEYWORD MATCHES]", "vector": "[SEMANTIC MATCHES]", "graph": "[GRAPH CONTEXT]"}
HISTORY, CONTEXT, QUESTION = "=== CONVERSATION HISTORY ===", "=== RETRIEVED CONTEXT ===", "=== QUESTION ==="


def format_context(results: DataFrame, chars: int = 500, graph_chars: int = 300) -> DataFrame:
    """(query_id, context) from (query_id, rank, source, document_id, text): results numbered within each source."""
    w = Window.partitionBy("query_id", "source").orderBy("rank")
    n = F.row_number().over(w)
    graph = F.col("source") == "graph"
    line = F.when(graph, F.concat(F.lit("- "), F.left("text", F.lit(graph_chars)))).otherwise(
        F.concat(n.cast("string"), F.lit(". ["), F.coalesce("document_id", F.lit("unknown")), F.lit("] "), F.left("text", F.lit(chars)))
    )
    ord_ = F.lit(None).cast("int")
    head = F.lit(None).cast("string")
    for i, (source, title) in enumerate(HEADINGS.items()):
        ord_ = F.when(F.col("source") == source, i).otherwise(ord_)
        head = F.when(F.col("source") == source, F.lit(title)).otherwise(head)
    lines = results.select(
        "query_id", ord_.alias("ord"), n.alias("n"), F.when(n == 1, F.concat(head, F.lit("\n"), line)).otherwise(line).alias("line")
    ).where("ord is not null")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "n", "line")))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


def recent_history(messages: DataFrame, turns: int = 3) -> DataFrame:
    """The last two messages for each of ``turns`` turns, (conv_id, turn, role, text)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= 2 * turns).drop("__n")


def history_block(messages: DataFrame, turns: int = 3) -> DataFrame:
    """(conv_id, history)."""
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return recent_history(messages, turns).groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("history"))


def build_prompt(history, context, question):
    """History, context and question, each under its heading; empty parts are left out."""
    part = lambda heading, body: F.when(F.coalesce(F.trim(body), F.lit("")) != "", F.concat(F.lit(heading + "\n\n"), body))
    return F.concat_ws("\n\n", part(HISTORY, history), part(CONTEXT, context), F.concat(F.lit(QUESTION + "\n\n"), question))
