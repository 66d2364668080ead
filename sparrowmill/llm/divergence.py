"""Source divergence audit in plain relational steps.

Terms are matches of a pattern; their counts and document numbers are grouped by language, source and term. A language
keeps the terms of enough documents. Groups are crossed with the kept terms of their language, so that absent ones count
zero, smoothed shares of the terms are made in whole numbers, and groups meet term by term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

#: What is left of the terms' signs once A-Z are small: a-z and all beyond ASCII, stated as ranges, which match several times as fast as what they exclude.
TERM = r"[a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups (language, source) that are sent to every task; beyond that they are joined by language and SALTS parts of the terms.
BROADCAST_GROUPS, SALTS = 100_000, 64


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, in_docs) of ``docs``: occurrences and rows that hold the term."""
    text = F.coalesce("text", F.lit(""))
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    terms = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)).alias("terms"))
    # every term with its occurrences, and behind them once more each distinct term of the row; the outer form keeps the pattern from being matched again to rule out empty lists
    both = terms.select("lang", "source", F.size("terms").alias("z"), F.concat("terms", F.array_distinct("terms")).alias("a"))
    rows = both.select("lang", "source", "z", F.posexplode_outer("a").alias("i", "term")).where("term is not null")
    return rows.groupBy("lang", "source", "term").agg(F.sum((F.col("i") < F.col("z")).cast("long")).alias("n"), F.sum((F.col("i") >= F.col("z")).cast("long")).alias("in_docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 * (count + 2) / (total + 2 * kept)), exact: as wide decimals, for counts of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, bottom = (wide(count) + F.lit(2)) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(total) + wide(kept) * F.lit(2)
    return F.call_function("div", top, bottom).cast("long") + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def by_lang(many: DataFrame, few: DataFrame, bounded: bool, *spread: str) -> DataFrame:
    """Join on lang of rows with few groups; where these are too many to broadcast, in SALTS parts by a hash of ``spread``."""
    if bounded:
        return many.join(F.broadcast(few), "lang")
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source; nulls are empty strings).

    Part "pair" has each other source of a group's language, at its distance over all kept terms (0 where none is kept);
    part "term" has the ``top`` terms that a group has and uses more than its language does, by their distance from it.
    Ranks go by value, largest first, ties by item. Rows are documents, so repeated rows count again; empty texts make
    groups without terms; long texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    own = Window.partitionBy("lang", "term")
    counts = term_counts(docs).select("lang", "source", "term", "n", F.sum("in_docs").over(own).alias("in_docs"), F.sum("n").over(own).alias("lang_n"), (F.min("source").over(own) == F.col("source")).alias("first"))
    held = common.stash(counts.where(F.col("in_docs") >= least_docs).drop("in_docs"), "held")
    langs = held.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = common.stash(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total"))), "groups")
    bounded = groups.count() <= BROADCAST_GROUPS
    # absent terms count zero
    crossed = by_lang(held.where("first").select("lang", "term"), groups.select("lang", "source", "total", "v"), bounded, "term")
    dense = crossed.join(held.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    dense = dense.select("lang", "term", "source", share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("v")).alias("p"))
    dense = common.stash(dense, "dense")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    half = dense.join(other, ["lang", "term"]).where(F.col("source") < F.col("item"))
    sums = half.groupBy("lang", "source", "item").agg(F.sum(distance(F.col("p"), F.col("q"))).alias("value"))
    # a distance is the same both ways
    both = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("k"), "value").select("lang", "k.*", "value")
    met = by_lang(groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item")), bounded, "source").where(F.col("source") != F.col("item"))
    pairs = met.join(both, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    own = held.join(F.broadcast(groups) if bounded else groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    more = own.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    more = more.select("lang", "source", F.lit("term").alias("part"), "item", distance(F.col("p"), F.col("q")).alias("value"))
    terms = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents: terms of at least 10 documents of a language, 10 terms a group."""
    return audit(common.load(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM f GROUP BY lang),
x AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM (SELECT lang, source, term FROM g JOIN f USING (lang)) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM x GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (total + 2 * v) AS p FROM x JOIN t USING (lang, source) JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + 1000000000 * (sum(n)::HUGEINT + 2) // (sum(sum(n)::HUGEINT) OVER (PARTITION BY lang)::HUGEINT + 2 * any_value(v)) AS q FROM x JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) s
  ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""
