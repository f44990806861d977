"""Removal of boilerplate lines that spread over many sites.

A line's spread is the number of distinct sites (sources) that have it. Lines
are keyed by a 64-bit hash of the trimmed line. A HyperLogLog sketch of the sites
of each line hash is built map-side from the lines as they occur and merged by
aggregation; only lines whose estimate is near the threshold get an exact
distinct count. Only DataFrame functions.

Copies of a document say nothing about its lines. Texts whose sets of lines are
alike (Jaccard ``MIN_ALIKE`` or more) are versions of one document and count in the
first of their sites only, so that a document that many sites copied keeps its
lines, for near-duplicate removal to judge it as a whole. A text is compared with
two others: the first of the texts with the same least, and with the same greatest,
MD5 among their lines. No single line decides: a notice of any length that stands
beside different lines counts in all of its sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm.common import documents, meet_groups
from lathework.session import materialize

MIN_SITES, LG_K, MIN_ALIKE = 6, 10, 0.8


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``(line, sites)`` for the line hashes of ``lines (line, site)`` that ``min_sites`` sites or more have.

    ``sites`` is exact near the threshold (within four standard errors of the
    sketch) and otherwise the rounded estimate. A null site is a site.
    """
    own = lines.select("line", F.coalesce(F.xxhash64("site"), F.lit(0)).alias("site"))
    slack = max(1.0, 4 * 1.04 / (2 ** (lg_k / 2)) * min_sites)
    sketched = own.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"))
    sketched = materialize(sketched.where(F.col("estimate") >= min_sites - slack), "sketches")
    near = sketched.where(F.col("estimate") < min_sites + slack).select("line")
    exact = own.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    far = sketched.where(F.col("estimate") >= min_sites + slack).select("line", F.col("estimate").cast("long").alias("sites"))
    return exact.unionByName(far)


def versions(texts: DataFrame, min_alike: float = MIN_ALIKE) -> DataFrame:
    """``texts (key, name, low, high, site, lines)`` with ``version``: the name of the text that a text is a version of.

    A row per text; ``name`` orders texts. Candidates are the first by name of
    those with the same ``low`` and of those with the same ``high``.
    """
    out = texts
    for end in ("low", "high"):
        first = texts.where(F.col(end).isNotNull()).groupBy(end).agg(F.min_by(F.struct("name", "lines"), "name").alias(f"_{end}"), F.count("*").alias("n")).where("n > 1").drop("n")
        # a merge join of two plain exchanges at every size: a hot key's rows can be split
        out = out.join(first.hint("merge"), end, "left")

    def alike(end: str) -> Column:
        other = F.col(f"_{end}.lines")
        shared = F.size(F.array_intersect("lines", other))
        return F.when(shared >= min_alike * (F.size(F.array_distinct("lines")) + F.size(F.array_distinct(other)) - shared), F.col(f"_{end}.name"))

    return out.select("key", "site", "lines", F.coalesce(alike("low"), alike("high"), "name").alias("version"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", lg_k: int = LG_K) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, and ``n_lines``, ``n_removed`` (in place of columns so named).

    Lines are the parts between ``\\n``; blank lines are never removed. Kept
    lines keep their order and white space; a text may be left with none. Null
    and empty texts are returned as they are, with no line. Each row is treated
    alike, however often it occurs. Texts are moved once, to meet the hashes of
    their own boilerplate lines. Other columns are never touched.
    """
    hashes = F.expr(f"transform(filter(split(`{text_col}`, '\\n', -1), x -> trim(x) <> ''), x -> xxhash64(trim(x)))")
    marks = F.expr(f"transform(filter(split(`{text_col}`, '\\n', -1), x -> trim(x) <> ''), x -> md5(trim(x)))")
    seen = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("key"), F.md5(text_col).alias("name"), F.col(site_col).alias("site"), hashes.alias("lines"), marks.alias("marks"))
    seen = seen.select("key", "name", "site", "lines", F.array_min("marks").alias("low"), F.array_max("marks").alias("high"))
    # one row for each text, then one site for each version; the first is null before all others
    least = F.min(F.struct(F.col("site").isNotNull().alias("has"), "site"))
    texts = seen.groupBy("key").agg(least.alias("one"), *[F.first(c).alias(c) for c in ("name", "low", "high", "lines")]).select("key", "name", "low", "high", "one.site", "lines")
    texts = materialize(versions(materialize(texts, "text_lines")).withColumn("salt", F.pmod("key", F.lit(32)).cast("int")), "text_versions")
    many = materialize(texts.groupBy("version").agg(least.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "versions")
    texts = meet_groups(texts, many, ["version"], "left").select("key", F.when(F.col("first").isNull(), F.col("site")).otherwise(F.col("first.site")).alias("site"), "lines")
    spread = materialize(spread_lines(texts.select(F.explode("lines").alias("line"), "site"), min_sites, lg_k), "spread_lines")
    # sets of a text's own boilerplate lines
    own = texts.select("key", F.explode(F.array_distinct("lines")).alias("line")).join(spread.select("line"), "line", "left_semi").groupBy("key").agg(F.collect_set("line").alias("_drop"))
    # a merge join of two plain exchanges at every size: what a hot key brings together can be split
    own = materialize(own.withColumnRenamed("key", "_key"), "drops").hint("merge")
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key"))
    keep = F.filter("_lines", lambda x: (F.trim(x) == "") | ~F.array_contains("_drop", line_hash(x)))
    done = (
        packed.join(own, "_key", "left")
        .withColumn("_lines", F.split("_text", "\n", -1))
        .withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(keep))
        .withColumn("_n", F.coalesce(F.when(F.col("_text") == "", F.lit(0)).otherwise(F.size("_lines")), F.lit(0)).cast("long"))
        .withColumn("_gone", F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_kept")).cast("long"))
        .withColumn("_text", F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")))
    )
    rest = [F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c == text_col or c in others]
    return done.select(*rest, F.col("_n").alias("n_lines"), F.col("_gone").alias("n_removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: id, lines, lines removed, and the text that is left."""
    found = remove_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return found.select("doc_id", "n_lines", "n_removed", F.col("text").alias("clean_text"))


#: The same in DuckDB, with exact distinct counts.
OP2_SQL = rf"""
with cut as (
  select doc_id, text, string_split(text, chr(10)) as parts, row_number() over () as rid from documents
), texts as (
  select row_number() over () as tid, text, min(coalesce(source, chr(0))) as source from documents where text is not null group by text
), cells as (
  select tid, source, trim(unnest(string_split(text, chr(10))), ' ') as line from texts
), sets as (
  select tid, any_value(source) as source, md5(any_value(text)) as name, list(distinct line) as own, min(md5(line)) as low, max(md5(line)) as high from cells join (select tid, text from texts) using (tid) where line <> '' group by 1
), ends as (
  select *, first_value(name) over l as lname, first_value(own) over l as lown, first_value(name) over h as hname, first_value(own) over h as hown from sets
  window l as (partition by low order by name), h as (partition by high order by name)
), versions as (
  select tid, source, case when len(list_intersect(own, lown)) >= {MIN_ALIKE} * (len(own) + len(lown) - len(list_intersect(own, lown))) then lname
    when len(list_intersect(own, hown)) >= {MIN_ALIKE} * (len(own) + len(hown) - len(list_intersect(own, hown))) then hname else name end as version from ends
), spread as (
  select line from cells join (select tid, min(source) over (partition by version) as first from versions) using (tid)
  where line <> '' group by 1 having count(distinct first) >= {MIN_SITES}
), lines as (
  select rid, unnest(parts) as line, unnest(range(len(parts))) as pos from cut where text is not null
), marked as (
  select l.rid, l.pos, l.line, s.line is not null as bad from lines l left join spread s on trim(l.line, ' ') = s.line
), per as (
  select rid, count(*) filter (bad) as n_bad, string_agg(line, chr(10) order by pos) filter (not bad) as kept from marked group by rid
)
select c.doc_id,
       cast(case when coalesce(c.text, '') = '' then 0 else len(c.parts) end as bigint) as n_lines,
       cast(coalesce(p.n_bad, 0) as bigint) as n_removed,
       case when p.n_bad > 0 then coalesce(p.kept, '') else c.text end as clean_text
from cut c left join per p on c.rid = p.rid
"""
