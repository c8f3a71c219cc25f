"""Secret scans by multipart credential linking.

Strong spans are reported as found: assignments of a password or key, access identifiers and long hex.
Weak candidates are parts that mean nothing alone: a named identifier (user, login, client id, account), a
loose key (20 or more characters of mixed case with a digit) and an endpoint (URL or host with port).  They
are joined by interval within a scope, the text between two blank lines: an identifier counts if a secret
starts within REACH code points of it, a key if an identifier does, an endpoint if both do.

Parts are distinct strings: of spans that overlap one counts, a strong one before an endpoint before an
identifier before a key, so an identifier's value is not its own secret and a path is not its URL's key.  An
assignment or hex that overlaps an access identifier is reported, but is no secret part: it is that identifier.

Matches of a kind and the gaps between them come from one extraction and one split; positions are running
sums over them, and the interval join is a range window over each scope.  Only DataFrame functions are used.

Nulls: a null text is an empty one.  Rows that agree in id and text get equal spans.  An empty table gives
an empty result.  Positions are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane.llm.common import settle, table

REACH = 400

#: Kinds in the order in which they are listed at one start; the pattern and the group whose length has to reach the least.
KINDS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "ident": (r"""(?:[Uu][Ss][Ee][Rr](?:[_-]?[Nn][Aa][Mm][Ee]|[_-]?[Ii][Dd])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt][_-]?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt](?:[_-]?[Ii][Dd])?|[Aa][Cc][Cc][Ee][Ss][Ss][_-]?[Kk][Ee][Yy](?:[_-]?[Ii][Dd])?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", 0, 6),
    "key": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
    "endpoint": (r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+|(?:[a-z0-9-]+\.)+[a-z]{2,}:[0-9]{2,5}""", 0, 8),
}
#: What a loose key has to contain besides its length.
MIXED = ("[0-9]", "[a-z]", "[A-Z]")
BREAK = r"\n[\x20\x09\x0B-\x0D]*\n"
STRONG = ("assign", "access", "hex")


def _pieces(text: Column, pattern: str, group: int, contains: tuple[str, ...] = ()) -> Column:
    """(gap, size, part) of each match, left to right: the code points between it and the one before, of it, and of the group.

    part is 0 for a match that lacks one of `contains`.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("f"), parts.alias("p"))

    def sized(x: Column) -> Column:
        part = F.length(x["p"])
        for pattern in contains:
            part = F.when(x["p"].rlike(pattern), part).otherwise(0)
        return F.struct(F.length(x["g"]).alias("gap"), F.length(x["f"]).alias("size"), part.alias("part"))

    sizes = F.transform(rows, sized)
    return F.when(text.rlike(pattern), sizes)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, row, found) for each row of docs: found has the pieces by kind, or is null where there are none; row is a hash of id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = {k: _pieces(F.col("t"), p, g, MIXED if k == "key" else ()) for k, (p, g, _) in KINDS.items()}
    kinds["access"] = F.when(F.col("t").contains("AKIA"), kinds["access"])
    kinds["endpoint"] = F.when(F.col("t").contains(":"), kinds["endpoint"])
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), text.alias("t")).select("doc_id", "row", "t", *[c.alias(f"f_{k}") for k, c in kinds.items()])
    some = F.coalesce(*[F.col(f"f_{k}") for k in kinds]).isNotNull()
    weak = F.coalesce(*[F.col(f"f_{k}") for k in kinds if k not in STRONG]).isNotNull()
    breaks = F.when(weak, _pieces(F.col("t"), BREAK, 0))
    listed = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(f"f_{k}").alias("pieces")) for i, k in enumerate(kinds)], F.struct(F.lit(99).alias("rank"), F.lit("break").alias("kind"), breaks.alias("pieces")))
    return rows.select("doc_id", "row", F.when(some, F.filter(listed, lambda x: x["pieces"].isNotNull())).alias("found"))


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, row, rank, kind, start, end) of the spans reported, from what scanned() returns."""
    key = ["doc_id", "row"]
    kinds = found.where("found IS NOT NULL").dropDuplicates(key).select(*key, F.explode("found").alias("f"))
    pieces = kinds.select(*key, "f.rank", "f.kind", F.posexplode("f.pieces").alias("at", "p"))
    before = Window.partitionBy(*key, "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("end", F.sum(F.col("p.gap") + F.col("p.size")).over(before)).withColumn("start", F.col("end") - F.col("p.size"))
    least = F.create_map(*[F.lit(x) for k, (_, _, n) in KINDS.items() for x in (k, n)])
    placed = placed.where((F.col("kind") == "break") | (F.col("p.part") >= F.coalesce(least[F.col("kind")], F.lit(0)))).select(*key, "rank", "kind", "start", "end")
    is_strong, is_break = F.col("kind").isin(*STRONG), F.col("kind") == "break"
    in_order = Window.partitionBy(*key).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    backwards = Window.partitionBy(*key).orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)

    def overlaps(test: Column) -> Column:
        """Whether a span shares a code point with one before or after it for which test holds."""
        end, start = F.max(F.when(test, F.col("end"))).over(in_order), F.min(F.when(test, F.col("start"))).over(backwards)
        return (F.coalesce(end, F.lit(0)) > F.col("start")) | (F.coalesce(start, F.col("end")) < F.col("end"))

    parts = placed.withColumn("_scope", F.coalesce(F.sum(F.when(is_break, 1)).over(in_order), F.lit(0))).withColumn("_over", overlaps(is_strong))
    parts = parts.where(~is_break & (is_strong | ~F.col("_over")))
    for above, below in (("endpoint", ("ident", "key")), ("ident", ("key",))):
        parts = parts.withColumn("_over", overlaps(F.col("kind") == above)).where(~(F.col("kind").isin(*below) & F.col("_over")))
    parts = parts.withColumn("_over", overlaps(F.col("kind") == "access"))
    is_ident, is_secret = F.col("kind").isin("access", "ident"), (F.col("kind") == "key") | (F.col("kind").isin("assign", "hex") & ~F.col("_over"))
    reach = Window.partitionBy(*key, "_scope").orderBy("start").rangeBetween(-REACH, REACH)
    linked = parts.withColumn("_ident", F.max(is_ident).over(reach)).withColumn("_secret", F.max(is_secret).over(reach))
    counts = is_strong | ((F.col("kind") == "ident") & F.col("_secret")) | ((F.col("kind") == "key") & F.col("_ident")) | ((F.col("kind") == "endpoint") & F.col("_ident") & F.col("_secret"))
    return linked.where(counts).select(*key, "rank", "kind", "start", "end")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the strong kinds, base_sha256 and spans of each row of docs."""
    found = settle(scanned(docs))
    one = F.struct("start", "rank", "kind", "end")
    strong = F.col("kind").isin(*STRONG)
    told = spans(found).groupBy("doc_id", "row").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in STRONG], F.collect_list(F.when(strong, one)).alias("base"), F.collect_list(one).alias("every"))
    told = told.select(F.col("doc_id").alias("_i"), F.col("row").alias("_r"), *[f"n_{k}" for k in STRONG], _joined(F.col("base")).alias("base"), _joined(F.col("every")).alias("spans"))
    rows = found.select("doc_id", "row").join(told, (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_i")), "left")
    counts = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in STRONG]
    return rows.select("doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same spans in DuckDB SQL, from the same patterns."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate([*KINDS.items(), ("break", (BREAK, 0, 0))]):
        mixed = " AND ".join(f"regexp_matches(f[i], '{p}')" for p in MIXED) if kind == "key" else "true"
        part = f"length(regexp_extract(f[i], {quoted(pattern)}, {group}))"
        found.append(f"SELECT rid, {99 if kind == 'break' else rank} AS rank, '{kind}' AS kind, i, length(g[i]) AS gap, length(f[i]) AS size, {part} >= {least} AND {mixed} AS good FROM (SELECT rid, g, f, unnest(range(1, len(f) + 1)) AS i FROM (SELECT rid, string_split_regex(t, {quoted(pattern)}) AS g, regexp_extract_all(t, {quoted(pattern)}) AS f FROM d))")
    strong = "kind IN ('assign', 'access', 'hex')"
    over = lambda test: f"(coalesce(max(CASE WHEN {test} THEN e END) OVER f, 0) > b OR coalesce(min(CASE WHEN {test} THEN b END) OVER g, e) < e)"
    windows = "WINDOW f AS (PARTITION BY rid ORDER BY b, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY rid ORDER BY b DESC, rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(found)}),
s AS (SELECT *, sum(gap + size) OVER (PARTITION BY rid, rank ORDER BY i) AS e FROM p),
n AS (SELECT rid, rank, kind, e - size AS b, e FROM s WHERE good),
n1 AS (SELECT *, count(CASE WHEN kind = 'break' THEN 1 END) OVER f AS scope, {over(strong)} AS o FROM n {windows}),
n2 AS (SELECT rid, rank, kind, b, e, scope, {over("kind = 'endpoint'")} AS o FROM n1 WHERE kind <> 'break' AND ({strong} OR NOT o) {windows}),
n3 AS (SELECT rid, rank, kind, b, e, scope, {over("kind = 'ident'")} AS o FROM n2 WHERE kind NOT IN ('ident', 'key') OR NOT o {windows}),
c AS (SELECT rid, rank, kind, b, e, scope, {over("kind = 'access'")} AS o FROM n3 WHERE kind <> 'key' OR NOT o {windows}),
l AS (SELECT *, bool_or(kind IN ('access', 'ident')) OVER r AS ident, bool_or(kind = 'key' OR (kind IN ('assign', 'hex') AND NOT o)) OVER r AS secret
      FROM c WINDOW r AS (PARTITION BY rid, scope ORDER BY b RANGE BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING)),
k AS (SELECT *, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT) AS x FROM l
      WHERE {strong} OR (kind = 'ident' AND secret) OR (kind = 'key' AND ident) OR (kind = 'endpoint' AND ident AND secret)),
a AS (SELECT rid, {", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in STRONG)}, string_agg(CASE WHEN {strong} THEN x END, ',' ORDER BY b, rank, e) AS base, string_agg(x, ',' ORDER BY b, rank, e) AS spans FROM k GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in STRONG)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


OP6_SQL = _sql()
