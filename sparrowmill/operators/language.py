"""Text language learned from labelled rows and applied as plain expressions.

A word gives two features, its first and its last three letters, as a number below BUCKETS. A language's profile is a
smoothed log share of each bucket, in whole thousandths; a text's language is that with the largest sum over its words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Buckets of features, and languages that a model may have: together the size of a model.
BUCKETS, MOST_LANGUAGES = 4096, 200
#: Language of a text without words.
DEFAULT = "en"


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the beginnings and endings of all words (runs of letters), lower case; a null text has none."""
    code = lambda s: F.ascii(s) * 961 + F.ascii(F.substring(s, 2, 1)) * 31 + F.ascii(F.substring(s, 3, 1))
    own = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.flatten(F.transform(own, lambda w: F.array(code(w) % buckets, (code(F.right(w, F.lit(3))) * 7 + 1) % buckets)))


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> dict[str, list[int]]:
    """Profiles of the languages of ``rows``: lang -> weight of each bucket. Rows without text or language take no part.

    Counts of all rows are summed in the tasks; what reaches the driver is a number for each language and bucket.
    """
    # the outer form keeps the features from being made again to rule out empty lists
    own = rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.explode_outer(features(F.col(text), buckets)).alias("b")).where("b IS NOT NULL")
    seen = own.groupBy("l", "b").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES * buckets + 1).collect()
    if len({r["l"] for r in seen}) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    counts: dict[str, dict[int, int]] = {}
    for r in seen:
        counts.setdefault(r["l"], {})[r["b"]] = r["n"]
    return {k: [round(1000 * math.log((c.get(b, 0) + 1) / (sum(c.values()) + buckets))) for b in range(buckets)] for k, c in counts.items()}


def language_of(text: Column, profiles: dict[str, list[int]], default: str = DEFAULT) -> Column:
    """The language with the largest sum of weights, the first by name among equals; ``default`` without words or profiles."""
    if not profiles:
        return F.lit(default)
    # folded to constants when planned; an entry is found by its place
    tables = {k: F.split(F.lit(",".join(map(str, w))), ",").cast("array<int>") for k, w in sorted(profiles.items())}

    def pick(own: Column) -> Column:
        total = lambda w: F.aggregate(own, F.lit(0).cast("long"), lambda s, b: s + F.element_at(w, b + 1))
        scores = F.array(*(F.struct(total(w).alias("total"), F.lit(-i).alias("i"), F.lit(k).alias("lang")) for i, (k, w) in enumerate(tables.items())))
        return F.when(F.size(own) > 0, F.array_max(scores)["lang"]).otherwise(default)

    # bound as a lambda variable, so that features are made once
    return F.get(F.transform(F.array(features(text, len(next(iter(profiles.values()))))), pick), F.lit(0))


def as_table(spark: SparkSession, profiles: dict[str, list[int]]) -> DataFrame:
    """(lang, bucket, weight), to be kept."""
    return spark.createDataFrame([(k, b, w) for k, own in sorted(profiles.items()) for b, w in enumerate(own)], "lang string, bucket int, weight int")


def from_table(table: DataFrame) -> dict[str, list[int]]:
    whole = table.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("w"))
    return {r["lang"]: [x["weight"] for x in r["w"]] for r in whole.collect()}
