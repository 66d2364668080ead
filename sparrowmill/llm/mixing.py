"""Mixing sources to target weights.

Sizes are added up by source; targets follow from the weights, with a cap on repetition whose excess is reshared; the rate
of a source is its target over its size. Every document comes floor(rate) times, and once more where a draw seeded by a
hash of its id falls under the fraction. Each source has several seeds to draw with and takes the one whose mix comes
nearest its target, so that a few long documents do not carry it away. All draws are fixed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Sources that are sent to every task as a table of rates; beyond that their rates are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Draws to choose from for each source.
SEEDS = 16


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: Column) -> Column:
    """A number in [0, 1), fixed by the document's id (null: one space) and the seed."""
    digest = F.md5(F.concat_ws(":", seed, F.coalesce(doc_id.cast("string"), F.lit(" "))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def ranked(sources: DataFrame, column: str) -> DataFrame:
    """``sources`` with ``nth``, the place of each row in the order of ``column``, nulls last.

    Rows are sorted in ranges; only the number of rows of each range meets on the driver.
    """
    held = common.stash(sources.orderBy(F.col(column).asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for p, n in sorted(held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        starts.append(F.struct(F.lit(p).cast("long").alias("p"), F.lit(before).cast("long").alias("b")))
        before += n
    if not starts:
        return held.withColumn("nth", F.lit(0).cast("long")).drop("at")
    start = F.map_from_entries(F.array(*starts))
    return held.withColumn("nth", F.element_at(start, part) + within).drop("at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, size).

    Sources in code point order, null last, weigh ``weights``, repeating, and share the whole size; a target stops at
    ``most`` times its source's size and its excess is shared by weight among the others, until none is above. An empty
    table gives no rows; sources without words have the target 0.
    """
    spark = sizes.sparkSession
    whole = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    held = common.stash(whole.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")), "sources")
    total, weight = (x or 0 for x in held.agg(F.sum("source_size"), F.sum("w")).first())
    rest, share = total, weight or 1
    # a source above its cap at some share stays above, as the share of the others only grows
    above = lambda: F.col("w") * F.lit(rest).cast("decimal(38,0)") > F.col("cap") * F.lit(share).cast("decimal(38,0)")
    while True:
        full, w = held.where(above()).agg(F.sum("cap"), F.sum("w")).first()
        now = total - (full or 0), weight - (w or 0)
        if now == (rest, share) or not now[1]:
            break
        rest, share = now
    own = (F.col("w") * F.lit(rest).cast("decimal(38,0)")).cast("double") / F.lit(float(share))
    return held.select("source", "source_size", F.when(above(), F.col("cap").cast("double")).otherwise(own).alias("target"))


def with_rates(docs: DataFrame, rates: DataFrame, key: str, bounded: bool) -> DataFrame:
    """``docs`` with the row of ``rates`` that has its source as ``key``; nulls are a source. Too many to broadcast are joined by shuffle, where adaptive plans split hot sources."""
    mine = F.broadcast(rates) if bounded else rates
    return docs.join(mine, docs["source"].eqNullSafe(mine[key]), "left").drop(key)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, size: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, source, text or ``size``) with size, source_size, target and copies: how often the mix takes each row.

    A null text has size 0; a null source is a source of its own, the last one; rows with equal ids and sources share
    their draw; every row stays, whatever it is repeated. The added columns are given underscores where ``docs`` has
    their names; an empty table gives no rows.
    """
    n_size, n_source, n_target, n_copies, key, rate, seed = common.fresh(docs.columns, "size", "source_size", "target", "copies", "_key", "_rate", "_seed")
    measured = docs.withColumn(n_size, words_in(F.col("text")) if size is None else size.cast("long"))
    slim = measured.select("doc_id", "source", F.col(n_size).alias("size"))
    targets = source_targets(slim, weights, most)
    per_copy = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = common.stash(targets.select(F.col("source").alias(key), "source_size", "target", per_copy.alias("rate")), "rates")
    bounded = rates.count() <= BROADCAST_SOURCES
    fraction = F.col("rate") - F.floor("rate")
    drawn = with_rates(slim, rates, key, bounded)
    extra = [F.sum(F.when(draw(F.col("doc_id"), F.lit(k)) < fraction, F.col("size")).otherwise(0)).alias(f"e{k}") for k in range(SEEDS)]
    sums = drawn.groupBy("source").agg(F.max("rate").alias("rate"), F.max("target").alias("target"), F.max("source_size").alias("source_size"), *extra)
    miss = lambda k: F.abs(F.floor("rate") * F.col("source_size") + F.col(f"e{k}") - F.col("target"))
    best = F.array_min(F.array(*(F.struct(miss(k).alias("miss"), F.lit(k).alias("k")) for k in range(SEEDS))))["k"]
    chosen = common.stash(sums.select(F.col("source").alias(key), F.col("source_size").alias(n_source), F.col("target").alias(n_target), F.col("rate").alias(rate), best.alias(seed)), "seeds")
    taken = with_rates(measured, chosen, key, bounded)
    copies = F.floor(rate) + F.when(draw(F.col("doc_id"), F.col(seed)) < F.col(rate) - F.floor(rate), 1).otherwise(0)
    return taken.withColumn(n_copies, copies.cast("int")).drop(rate, seed)


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """The mix: each row as often as ``copies`` says, with ``copy`` from 0."""
    return mixed.where(F.col(copies) > 0).withColumn(common.fresh(mixed.columns, "copy")[0], F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    docs = common.load(spark, sf_dir, "documents")
    # texts are read once: what follows works on ids, sources and sizes
    sizes = common.stash(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "sizes")
    mixed = mix(sizes.withColumnRenamed("size", "n"), size=F.col("n"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][nth % 3 + 1] AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum([5, 2, 1][nth % 3 + 1]) OVER () AS share FROM s),
-- by the share at which a source is full: those before it are full at any larger one
o AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  share - coalesce(sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w FROM w),
l AS (SELECT arg_min(rest, cap / w) FILTER (w * rest <= cap * left_w) AS rest, arg_min(left_w, cap / w) FILTER (w * rest <= cap * left_w) AS left_w FROM o),
t AS (SELECT source, source_size, CASE WHEN w * l.rest > cap * l.left_w THEN CAST(cap AS DOUBLE) ELSE CAST(w * l.rest AS DOUBLE) / CAST(l.left_w AS DOUBLE) END AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
u AS (SELECT d.doc_id, d.size, r.*, k, CAST('0x' || substr(md5(k || ':' || coalesce(CAST(doc_id AS VARCHAR), ' ')), 1, 13) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) AS more
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range({SEEDS}) x(k)),
m AS (SELECT source, k, abs(any_value(floor(rate) * source_size) + coalesce(sum(size) FILTER (more), 0) - any_value(target)) AS miss FROM u GROUP BY source, k),
b AS (SELECT source, arg_min(k, (miss, k)) AS k FROM m GROUP BY source)
SELECT u.doc_id, u.size, u.source_size, u.target, CAST(u.size * (floor(u.rate) + u.more::INT) AS BIGINT) AS taken, CAST(floor(u.rate) + u.more::INT AS INTEGER) AS copies
FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source AND u.k = b.k
"""
