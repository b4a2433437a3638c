"""Secret scans by corpus-wide ownership frequency, in DataFrame functions alone.

Every text is searched for candidate spans. The candidates' values are hashed and counted over the
whole corpus by distinct owners and repositories: a value that many owners hold is a widely copied
example, one that few owners hold and that looks random is a live credential. Base spans are always
reported; the method's own spans (provider formats, opaque random strings) only when live.

For `documents`, an owner is a source and a repository is a document.

Defined results: a null or empty text has no spans and the checksum of the empty string; a null owner
or repository counts as one more owner or repository; repeated rows each get their spans, and count
once; extra columns are ignored by `scan` and kept by `redact`; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

#: kind -> (pattern, group that is the value, its fewest characters); base kinds first, as listed.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),  # AKIA[A-Z0-9]+ of 16 or more: a run fits as a whole or nowhere
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "provider": (r"(?:gh[opsru]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})", 0, 20),
    "opaque": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
#: A text that lacks this has no candidate of the kind; all cheap.
MAY = {"assign": r"(?i)passw|secret|token|api_?key", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "provider": "gh[opsru]_|xox[abprs]-|AIza|sk_live_|eyJ", "opaque": "[0-9]"}
#: Values that as many distinct owners hold are examples.
WIDE_OWNERS = 3
#: A live-looking value has so many distinct characters and digits, and no such word.
LIVE_CHARS, LIVE_DIGITS = 8, 3
PLACEHOLDER = r"(?i)example|changeme|dummy|sample|placeholder|xxxx|your_|1234567|abcdefg"
MASK = "<secret>"


def _found(text: Column, kind: str, order: int) -> Column:
    """array<struct<kind, gap, hit, value>> of one kind: gap is the number of characters between the
    last match and this one."""
    pattern, group, _ = KINDS[kind]
    hits, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    one = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value")), lambda x: F.struct(F.lit(order).alias("kind"), x["gap"].alias("gap"), x["hit"].alias("hit"), x["value"].alias("value")))
    return F.when(text.rlike(MAY[kind]), one).otherwise(F.array().cast("array<struct<kind:int,gap:int,hit:string,value:string>>"))


def candidates(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_found(text, k, i) for i, k in enumerate(KINDS)])


def _looks_live(v: Column) -> Column:
    return (F.size(F.array_distinct(F.split(v, ""))) >= LIVE_CHARS) & (F.length(F.regexp_replace(v, "[^0-9]", "")) >= LIVE_DIGITS) & ~v.rlike(PLACEHOLDER)


def spans(held: DataFrame) -> DataFrame:
    """Of a frozen table (row, owner, repo, found): row, at: array<struct<start, kind, end, live, wide>>
    sorted, for rows that have any. kind is the number in KINDS."""
    each = held.filter(F.size("found") > 0).select("row", "owner", "repo", F.posexplode("found").alias("pos", "x")).select("row", "owner", "repo", "pos", "x.*")
    # all of a window is one document's
    upto = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto).cast("int")).withColumn("start", (F.col("end") - F.length("hit")).cast("int"))
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in KINDS.values()]), F.col("kind") + 1)
    each = each.filter(F.length("value") >= least).withColumn("hash", F.sha2("value", 256)).withColumn("looks", _looks_live(F.col("value")))
    each = each.filter((F.col("kind") < len(BASE)) | F.col("looks")).select("row", "owner", "repo", "kind", "start", "end", "hash", "looks")
    each = materialize(each, "candidates")
    # copies of a value shrink to one row an owner and repository before they meet
    owned = each.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    owners = owned.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))
    known = each.join(owners, "hash").select("row", "kind", "start", "end", (F.col("n_owners") >= WIDE_OWNERS).alias("wide"), "looks", "n_owners", "n_repos")
    known = known.withColumn("live", ~F.col("wide") & F.col("looks")).filter((F.col("kind") < len(BASE)) | F.col("live"))
    at = known.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "wide", "n_owners", "n_repos"))).alias("at"))
    base = F.filter("at", lambda x: x["kind"] < len(BASE))
    inside = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return at.withColumn("base", base).select("row", F.filter("at", lambda s: (s["kind"] < len(BASE)) | ~inside(s)).alias("at"))


def _said(at: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(at, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _frozen(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None, *more: Column) -> DataFrame:
    column = lambda c: F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit("")
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), column(owner_col).alias("owner"), column(repo_col).alias("repo"), candidates(F.col(f"`{text_col}`")).alias("found"), *more), "found")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and how many of the
    spans are live or widely copied, with the live ones' spans."""
    held = _frozen(docs, id_col, text_col, owner_col, repo_col)
    out = held.select("row", "doc_id").join(spans(held), "row", "left")
    at = F.coalesce("at", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,wide:boolean,n_owners:bigint,n_repos:bigint>>"))
    out = out.select("doc_id", at.alias("at"))
    count = lambda test: F.size(F.filter("at", test)).cast("long")
    of_kind = lambda i: lambda s: s["kind"] == i
    return out.select(
        "doc_id",
        *[count(of_kind(i)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_said(F.filter("at", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        _said(F.col("at")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["wide"]).alias("n_wide"),
        _said(F.filter("at", lambda s: s["live"])).alias("live_spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "doc_id") -> DataFrame:
    """docs with every span but widely copied examples replaced by MASK, and n_chars (if there) set
    anew in changed rows; same rows and columns."""
    held = _frozen(docs, id_col, text_col, owner_col, repo_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    hide = spans(held).select("row", F.filter("at", lambda s: ~s["wide"]).alias("at")).filter(F.size("at") > 0)
    text = F.col("doc").getField(text_col)
    between = lambda a, b: F.substring(text, a + 1, b - a)

    def step(acc, s):
        new = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], F.concat(acc["out"], between(acc["pos"], s["start"]), F.lit(MASK))).otherwise(acc["out"]).alias("out"))
        return new

    masked = F.aggregate("at", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], between(acc["pos"], F.length(text))))
    out = held.select("row", "doc").join(hide, "row", "left").withColumn("new", F.when(F.col("at").isNotNull(), masked))

    def column(c: str) -> Column:
        own = F.col("doc").getField(c)
        if c == text_col:
            return F.coalesce("new", own).alias(c)
        return (F.when(F.col("new").isNotNull(), F.length("new").cast(dict(docs.dtypes)[c])).otherwise(own) if c == "n_chars" else own).alias(c)

    return out.select(*map(column, docs.columns))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def one(i: int, k: str) -> str:
        pattern, group, least = KINDS[k]
        p = pattern.replace("'", "''")
        return f"""SELECT r, owner, repo, {i} AS kind, unnest(range(1, len(hits) + 1)) AS pos, hits, vals, gaps, {least} AS least FROM
  (SELECT r, owner, repo, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {group}) AS vals, string_split_regex(text, '{p}') AS gaps FROM d WHERE regexp_matches(text, '{MAY[k]}'))"""

    said = lambda test: f"coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER ({test}), '')"
    nb = len(BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source AS owner, CAST(doc_id AS VARCHAR) AS repo FROM documents),
f AS ({" UNION ALL ".join(one(i, k) for i, k in enumerate(KINDS))}),
g AS (SELECT r, owner, repo, kind, least, vals[pos] AS v, length(hits[pos]) AS n, sum(length(gaps[pos]) + length(hits[pos])) OVER (PARTITION BY r, kind ORDER BY pos) AS e FROM f),
h AS (SELECT r, owner, repo, kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e, v, len(list_distinct(string_split(v, ''))) >= {LIVE_CHARS} AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= {LIVE_DIGITS} AND NOT regexp_matches(v, '{PLACEHOLDER}') AS looks FROM g WHERE length(v) >= least),
k AS (SELECT * FROM h WHERE kind < {nb} OR looks),
o AS (SELECT v, count(DISTINCT owner) >= {WIDE_OWNERS} AS wide FROM k GROUP BY v),
l AS (SELECT k.*, wide, NOT wide AND looks AS live, [{", ".join(f"'{x}'" for x in KINDS)}][kind + 1] AS name FROM k JOIN o USING (v) WHERE kind < {nb} OR (NOT wide AND looks)),
q AS (SELECT * FROM l WHERE kind < {nb} OR NOT EXISTS (SELECT 1 FROM l b WHERE b.r = l.r AND b.kind < {nb} AND b.s < l.e AND l.s < b.e))
SELECT any_value(d.doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{x}" for i, x in enumerate(BASE))}, sha256({said(f"kind < {nb}")}) AS base_sha256, {said("kind >= 0")} AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (wide) AS n_wide, {said("live")} AS live_spans
FROM d LEFT JOIN q USING (r) GROUP BY r"""


SQL = _sql()
