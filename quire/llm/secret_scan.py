"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns (assign, access, hex) are reported wherever they match. Weak parts (id, key, endpoint)
are reported only next to a complementary part: an interval join over scopes of ``SCOPE`` code points
links access identifiers, secrets and endpoints of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


SCOPE = 200
_LINK = r"""["']?\x20*[:=]\x20*["']?"""
KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
PATTERNS = {
    "assign": f"({_either_case('password|passwd|secret|token|api_?key')}){_LINK}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "id": f"({_either_case('username|user|login|account|client_?id')}){_LINK}([A-Za-z0-9._@+-]+)",
    "key": "[A-Za-z0-9+/]{32,}",
    "endpoint": "(https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3|ftp)://([A-Za-z0-9._:@/-]+)",
}
LEAST = {"assign": ("value", 6), "access": ("hit", 20), "hex": ("hit", 24), "id": ("value", 3), "key": ("hit", 32), "endpoint": ("value", 4)}
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "id": "identifier", "key": "secret", "endpoint": "endpoint"}
NEEDS = {"id": ("secret",), "key": ("identifier", "endpoint"), "endpoint": ("secret",)}
BASE = 3


def _case(column: str, values: dict[str, str]):
    out = F.lit(None).cast("string")
    for kind, value in values.items():
        out = F.when(F.col(column) == kind, F.lit(value)).otherwise(out)
    return out


def _match(order: int):
    return lambda z, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), z["gap"].alias("gap"), z["hit"].alias("hit"), z["value"].alias("value"))


def find_parts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, ord, start, end, least ok): matches of every pattern in every text, and one row of null kind a document.

    Positions come from the lengths of the matches and of the gaps between them, in code points.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    per_kind = []
    for order, kind in enumerate(KINDS):
        pattern = F.lit(PATTERNS[kind])
        grouped = "(" in PATTERNS[kind]
        gaps = F.transform(F.split(F.col("__text"), PATTERNS[kind], -1), F.length)
        hits = F.transform(F.regexp_extract_all(F.col("__text"), pattern, F.lit(0)), F.length)
        values = F.transform(F.regexp_extract_all(F.col("__text"), pattern, F.lit(2)), F.length) if grouped else hits
        found = F.rlike(F.col("__text"), pattern) if kind != "access" else F.contains(F.col("__text"), F.lit("AKIA"))
        zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
        as_structs = F.filter(zipped, lambda z: z["hit"].isNotNull())
        per_kind.append(F.when(found, F.transform(as_structs, _match(order))))
    parts = F.flatten(F.filter(F.array(*per_kind), lambda a: a.isNotNull()))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text.alias("__text"))
    found = rows.select("row", "doc_id", F.explode_outer(parts).alias("m")).select("row", "doc_id", "m.*")
    found = materialize(found, "secret-matches")
    so_far = Window.partitionBy("row", "ord").orderBy("i")
    end = F.sum(F.col("gap") + F.col("hit")).over(so_far)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("ord") + 1)
    ok = F.lit(False)
    for order, k in enumerate(KINDS):
        ok = F.when(F.col("ord") == order, F.col(LEAST[k][0]) >= LEAST[k][1]).otherwise(ok)
    placed = found.where("ord is not null").select(
        "row", "doc_id", "ord", kind.alias("kind"), (end - F.col("hit")).alias("start"), end.alias("end"), ok.alias("ok")
    ).where("ok").drop("ok")
    return placed.unionByName(
        found.select("row", "doc_id").distinct().select(
            "row", "doc_id", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("kind"),
            F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")
        )
    )


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans array<struct<start, ord, kind, end>>): one row for each row of ``docs``, spans in order.

    Null and empty texts have none. Equal rows are scanned each on their own; a null doc_id stays null.
    A weak part needs a complementary part that starts within ``scope`` code points of its start in the same
    document. An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    parts = materialize(find_parts(docs), "secret-parts")
    at = F.floor(F.col("start") / scope)
    weak = parts.where(F.col("kind").isin(*NEEDS)).withColumn("bucket", at)
    wanted = F.array(*[F.when(_case("kind", ROLE).isin(*roles), F.lit(k)) for k, roles in NEEDS.items()])
    helpers = (
        parts.where("kind is not null")
        .select(
            F.col("row").alias("h_row"), F.col("start").alias("h_start"),
            F.explode(F.filter(wanted, lambda k: k.isNotNull())).alias("helps"), at.alias("h_at")
        )
        .withColumn("h_bucket", F.explode(F.sequence(F.col("h_at") - 1, F.col("h_at") + 1)))
    )
    near = (F.col("row") == F.col("h_row")) & (F.col("bucket") == F.col("h_bucket")) & (F.col("kind") == F.col("helps")) & (F.abs(F.col("start") - F.col("h_start")) <= scope)
    linked = weak.join(helpers, near, "left_semi").drop("bucket")
    kept = parts.where(F.col("kind").isNull() | (F.col("ord") < BASE)).unionByName(linked)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "ord", "kind", "end"))
    return kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents; edge cases as of ``scan``."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["ord"] < BASE)
    count = lambda o: F.size(F.filter("spans", lambda s: s["ord"] == o)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def brute_force(text: str | None, scope: int = SCOPE) -> list[tuple[int, int, str, int]]:
    """(start, ord, kind, end) of all spans of one text, by Python's own regular expressions."""
    import re

    text, parts = text or "", []
    for order, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            what, least = LEAST[kind]
            if len(m[2] if what == "value" else m[0]) >= least:
                parts.append((m.start(), order, kind, m.end()))
    keep = [p for p in parts if p[1] < BASE or any(ROLE[q[2]] in NEEDS[p[2]] and abs(p[0] - q[0]) <= scope for q in parts)]
    return sorted(keep)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, string_split_regex(text, {_quoted(PATTERNS[k])}) AS g, regexp_extract_all(text, {_quoted(PATTERNS[k])}) AS h, "
    f"regexp_extract_all(text, {_quoted(PATTERNS[k])}, {2 if '(' in PATTERNS[k] else 0}) AS v FROM documents WHERE regexp_matches(text, {_quoted(PATTERNS[k])})"
    for i, k in enumerate(KINDS)
)
_OK = " ".join(f"WHEN {i} THEN {'v' if LEAST[k][0] == 'value' else 'n'} >= {LEAST[k][1]}" for i, k in enumerate(KINDS))
_KIND = f"[{', '.join(map(repr, KINDS))}]"
_HELPS = " OR ".join(f"(w.kind = '{k}' AND h.kind IN ({', '.join(repr(x) for x in KINDS if ROLE[x] in roles)}))" for k, roles in NEEDS.items())
ORACLE = f"""
WITH m AS ({_MATCHES}),
e AS (SELECT doc_id, ord, g, h, v, unnest(range(1, len(h) + 1)) AS i FROM m),
l AS (SELECT doc_id, ord, i, length(h[i]) AS n, length(v[i]) AS v, CAST(sum(length(g[i]) + length(h[i])) OVER (PARTITION BY doc_id, ord
  ORDER BY i) AS BIGINT) AS e FROM e),
p AS (SELECT doc_id, ord, ({_KIND})[ord + 1] AS kind, e - n AS s, e FROM l WHERE CASE ord {_OK} END),
k AS (SELECT * FROM p WHERE ord < {BASE} UNION ALL
      SELECT * FROM p w WHERE ord >= {BASE} AND EXISTS (SELECT 1 FROM p h WHERE h.doc_id = w.doc_id AND abs(h.s - w.s) <= {SCOPE} AND ({_HELPS}))),
a AS (SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n0, count(*) FILTER (WHERE ord = 1) AS n1, count(*) FILTER (WHERE ord = 2) AS n2,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE ord < {BASE}) AS b,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS t FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
  coalesce(t, '') AS spans
FROM documents LEFT JOIN a USING (doc_id)
"""
