"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong kinds (assign, access, hex) are always reported.  Weak kinds are single parts of a credential that mean nothing
alone: account identifiers, bare key material and endpoints.  A weak part is reported only where the parts
that complete it lie in its scope, the SCOPE code points around it in the same text.

Offsets come from cutting the text at the matches: the lengths of the pieces and of the matches, summed up, are
the places.  The interval join is two running windows over the parts of a document, forwards and
backwards, that hold the nearest end and the nearest start of each role; a part meets a role if one of
them is in reach.  So a document with n parts costs n log n and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table

#: Code points between two parts that still belong together.
SCOPE = 200

_VALUE = "[A-Za-z0-9+/_.=-]+"
#: Fixed patterns, in the order in which equal starts are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(""" + _VALUE + ")"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:username|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
KEY = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""(?:https?|ftp|postgres|mysql|redis|mongodb|amqp)://[^\x00-\x20"'<>]+"""
KINDS = ["assign", "access", "hex", "ident", "key", "endpoint"]
STRONG = 3


def _matches(text: Column, kind: int, pattern: str, when: Column) -> Column:
    """Array of (kind, i, gap, size, value_size): gap code points, then a match, again and again."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = lambda m: F.length(F.regexp_extract(m, pattern, 1)) if kind == 0 else F.lit(99)
    rows = F.zip_with(
        F.transform(found, lambda m, i: F.struct(i.alias("i"), F.length(m).alias("size"), value(m).alias("value_size"))),
        F.transform(pieces, lambda p: F.length(p)),
        lambda m, gap: F.struct(F.lit(kind).alias("kind"), m["i"].alias("i"), gap.alias("gap"), m["size"].alias("size"), m["value_size"].alias("value_size")),
    )
    return F.when(when, F.filter(rows, lambda r: r["i"].isNotNull()))


def parts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """All matches of all kinds, a row each, and a row without kind for every text that has none."""
    text = F.col("_text")
    low = F.col("_low")
    has = lambda *words: F.coalesce(*[F.when(low.contains(w), True) for w in words], F.lit(False))
    assign, access = has("password", "passwd", "secret", "token", "apikey", "api_key"), text.contains("AKIA")
    ident = has("user", "login", "clientid", "client_id", "account")
    owner = access | ident
    found = [
        _matches(text, 0, ASSIGN, assign),
        _matches(text, 1, ACCESS, access),
        _matches(text, 2, HEX, text.rlike(HEX)),
        _matches(text, 3, IDENT, ident),
        _matches(text, 4, KEY, owner & text.rlike("[A-Za-z0-9+/]{32}")),
        _matches(text, 5, ENDPOINT, owner & text.contains("://")),
    ]
    none = F.expr("cast(array() as array<struct<kind:int,i:int,gap:int,size:int,value_size:int>>)")
    flat = (
        docs.select(
            F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in keep]).alias("row"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
        )
        .withColumn("_low", F.lower("_text"))
        .select("row", F.concat(*[F.coalesce(f, none) for f in found]).alias("found"))
        .withColumn("rid", F.monotonically_increasing_id())
    )
    return flat.select("rid", "row", F.explode_outer("found").alias("m")).select("rid", "row", "m.*")


def find(docs: DataFrame, keep: list[str], scope: int = SCOPE) -> DataFrame:
    """``row`` (struct of the kept columns), spans: array of (first, kind_no, past, kind), by first and kind.

    One row per input row, repeated rows included; null and empty texts have no spans.  Places are in code
    points, the end exclusive.  A weak part that overlaps a strong one is not listed again.
    """
    prepare(docs.sparkSession)
    own = Window.partitionBy("rid", "kind").orderBy("i")
    placed = (
        parts(docs, keep)
        .repartition("rid")
        .withColumn("past", F.sum((F.col("gap") + F.col("size")).cast("bigint")).over(own))
        .withColumn("first", F.col("past") - F.col("size"))
        .withColumn("kind", F.when(F.col("value_size") >= 6, F.col("kind")))
    )
    ahead = Window.partitionBy("rid").orderBy("first", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("rid").orderBy(F.desc("first"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    roles = {"owner": kind.isin(1, 3), "secret": kind.isin(0, 2, 4), "strong": kind < STRONG}
    for name, of in roles.items():
        placed = placed.withColumn(f"{name}_past", F.max(F.when(of, F.col("past"))).over(ahead))
    for name, of in roles.items():
        placed = placed.withColumn(f"{name}_next", F.min(F.when(of, F.col("first"))).over(behind))

    def meets(name: str) -> Column:
        before = F.col("first") - F.col(f"{name}_past") <= scope
        after = F.col(f"{name}_next") - F.col("past") <= scope
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    covered = F.coalesce(F.col("strong_past") > F.col("first"), F.lit(False)) | F.coalesce(
        F.col("strong_next") < F.col("past"), F.lit(False)
    )
    linked = (
        F.when(kind == 3, meets("secret")).when(kind == 4, meets("owner")).when(kind == 5, meets("owner") & meets("secret"))
    )
    shown = (kind < STRONG) | (linked & ~covered)
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)
    span = F.when(
        F.coalesce(shown, F.lit(False)),
        F.struct(F.col("first"), kind.alias("kind_no"), F.col("past"), names.alias("kind")),
    )
    return placed.groupBy("rid").agg(F.first("row").alias("row"), F.array_sort(F.collect_list(span)).alias("spans")).drop("rid")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["first"].cast("string"), F.lit(":"), s["past"].cast("string"))), ","
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with counts and a digest of the base ones.

    Null and empty texts have no spans and the digest of nothing; repeated rows have equal results; spans of one start stand in the
    order of kinds; whole texts count, however long; an empty table gives an empty result.
    """
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind_no"] < STRONG)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _kinds_sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = [ASSIGN, ACCESS, HEX, IDENT, KEY, ENDPOINT]
    return ", ".join(f"({k}, '{name}', {quote(p)})" for k, (name, p) in enumerate(zip(KINDS, patterns, strict=True)))


OP2_SQL = f"""
WITH kinds(k, kind, re) AS (VALUES {_kinds_sql()}),
cuts AS (SELECT doc_id, k, kind, re, string_split_regex(t, re) AS p, regexp_extract_all(t, re, 0) AS m
         FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), kinds WHERE regexp_matches(t, re)),
laid AS (SELECT doc_id, k, kind, re, i, m[i] AS v, length(m[i]) AS size, length(p[i]) AS gap FROM cuts, unnest(range(1, len(m) + 1)) AS t(i)),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, k ORDER BY i) AS past FROM laid),
spans AS (SELECT doc_id, k, kind, (past - size)::BIGINT AS first, past::BIGINT AS past FROM placed
          WHERE k > 0 OR length(regexp_extract(v, re, 1)) >= 6),
judged AS (
  SELECT s.*,
    k < {STRONG} OR (NOT exists(SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND o.k < {STRONG} AND o.first < s.past AND o.past > s.first)
      AND (k = 3 OR exists(SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND (o.k, o.first) <> (s.k, s.first) AND o.k IN (1, 3)
                AND greatest(o.first - s.past, s.first - o.past) <= {SCOPE}))
      AND (k = 4 OR exists(SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND (o.k, o.first) <> (s.k, s.first) AND o.k IN (0, 2, 4)
                AND greatest(o.first - s.past, s.first - o.past) <= {SCOPE}))) AS shown
  FROM spans s),
lines AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || first || ':' || past, ',' ORDER BY first, k) FILTER (k < {STRONG}) AS base,
    string_agg(kind || ':' || first || ':' || past, ',' ORDER BY first, k) AS spans FROM judged WHERE shown GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN lines USING (doc_id)
"""
