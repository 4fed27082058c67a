"""Operator 1: secret scanning with corpus-wide ownership frequency, in built-in functions only.

Candidates are the matches of three base rules (assignments, access keys, long
hexadecimal strings) and opaque tokens: 20 or more token characters with
letters and digits, outside base spans, with at least MIN_DISTINCT different
characters. Every candidate value is hashed, and the hashes are counted over
the whole corpus by distinct repositories and owners. A value that only one
owner has, in at most LIVE_REPOSITORIES repositories, is live-looking; one
that more owners have is a widely copied example. Base spans are always
reported; of the opaque tokens those that are live-looking are added, as
spans of kind "live".

Counting groups by (value, owner, repository) first and by (value, owner) and
(value) next, each combined within tasks before it is shuffled, so that a
value that a third of all rows have is no hot key. Positions are code points,
end exclusive, from the lengths of a text's pieces between matches.

Defined results: a null text is empty; a null owner is an owner of its own, a
null repository one of its own; equal rows get equal results; spans that start
together are in the order assign, access, hex, live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import cut, saved, table

# The base rules. The second group of "assign" has 6 characters or more.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")
MIN_VALUE, MIN_DISTINCT, LIVE_REPOSITORIES = 6, 10, 5


def matches(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), found.alias("match"))

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["match"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span))).alias("out"))

    empty = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,value:string>>)")
    spans = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    # Most texts have no match: one search settles them.
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(empty)


def _is_opaque(value: Column) -> Column:
    kinds = F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]"))
    return kinds & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT)


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """Rows (key, doc_id, owner, repo, base, opaque): the candidates of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.xxhash64("doc_id", text).alias("key"),
        F.col("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repo"),
        F.filter(matches(text, ASSIGN, 0), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= MIN_VALUE).alias("assign"),
        F.concat(matches(text, ACCESS, 1), matches(text, HEX, 2)).alias("others"),
        F.filter(matches(text, OPAQUE, 3), lambda m: _is_opaque(m["value"])).alias("opaque"),
    )

    def secret(m):
        value = F.when(m["kind"] == 0, F.regexp_extract(m["value"], ASSIGN, 2)).otherwise(m["value"])
        return F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.sha2(value, 256).alias("value"))

    base = F.transform(F.array_sort(F.concat("assign", "others")), secret)
    outside = F.filter("opaque", lambda m: ~F.exists(F.concat("assign", "others"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.select("key", "doc_id", "owner", "repo", base.alias("base"), F.transform(outside, secret).alias("opaque"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Rows (value, n_owners, n_repos) from (value, owner, repo)."""
    once = candidates.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    each = once.groupBy("value", "owner").agg(F.sum("one").alias("n"))
    return each.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def secret_scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, base, live (arrays of spans), n_live and n_copied (candidates by the corpus's verdict)."""
    rows = saved(scan(docs, repository, owner))
    each = rows.select("key", "owner", "repo", F.explode(F.concat("base", "opaque")).alias("m")).select("key", "owner", "repo", "m.*")
    verdicts = cut(ownership(each).select("value", ((F.col("n_owners") == 1) & (F.col("n_repos") <= LIVE_REPOSITORIES)).alias("live"), (F.col("n_owners") > 1).alias("copied")))
    spans = each.join(verdicts, "value").select("key", "live", "copied", "start", "kind", "end")
    one = F.struct("start", "kind", "end")
    found = spans.distinct().groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("live") & (F.col("kind") == 3), one))).alias("added"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
    )
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    base = F.transform("base", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    out = rows.select("key", "doc_id", base.alias("base")).join(found, "key", "left")
    return out.select("doc_id", "base", F.coalesce("added", none).alias("live"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"], m["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(F.array_sort(F.concat("base", "live"))).alias("spans"),
        "n_live",
        "n_copied",
    )


def _sql_matches(name: str, pattern: str, kind: int, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT k, doc_id, owner, i,
         CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda g: length(g))), 0) AS BIGINT) AS s,
         {kind} AS kind, length(found[i]) AS n, found[i] AS m
  FROM (SELECT k, doc_id, owner, regexp_split_to_array(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}', 0) AS found FROM d WHERE regexp_matches(t, '{quoted}')) x,
       unnest(range(1, len(found) + 1)) AS u(i)
  WHERE {keep})"""


_ASSIGN_SQL = ASSIGN.replace("'", "''")
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
{_sql_matches("a", ASSIGN, 0, f"length(regexp_extract(found[i], '{_ASSIGN_SQL}', 2)) >= {MIN_VALUE}")},
{_sql_matches("b", ACCESS, 1, "true")},
{_sql_matches("c", HEX, 2, "true")},
{_sql_matches("o", OPAQUE, 3, f"regexp_matches(found[i], '[0-9]') AND regexp_matches(found[i], '[A-Za-z]') AND len(list_distinct(string_split(found[i], ''))) >= {MIN_DISTINCT}")},
base AS (SELECT *, regexp_extract(m, '{_ASSIGN_SQL}', 2) AS v FROM a UNION ALL SELECT *, m FROM b UNION ALL SELECT *, m FROM c),
cand AS (SELECT * FROM base UNION ALL SELECT *, m FROM o WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.k = o.k AND base.s < o.s + o.n AND o.s < base.s + base.n)),
own AS (SELECT v, count(DISTINCT coalesce(owner, chr(1))) AS owners, count(DISTINCT (owner, doc_id)) AS repos FROM cand GROUP BY v),
said AS (SELECT cand.*, (owners = 1 AND repos <= {LIVE_REPOSITORIES}) AS live, owners > 1 AS copied,
                ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || s || ':' || (s + n) AS txt FROM cand JOIN own USING (v)),
per AS (SELECT k, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               coalesce(string_agg(txt, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base,
               coalesce(string_agg(txt, ',' ORDER BY s, kind) FILTER (kind < 3 OR live), '') AS spans,
               count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied FROM said GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per USING (k)
"""
