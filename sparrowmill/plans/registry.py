"""All registered queries of the core operators on the given tables, with their SQL.

``documents.text`` split at line ends stands in for captions, ``source`` for the shard, ``labels`` for a partial mapping,
``conversations`` for (reference, hypothesis) pairs and ``events`` for utterances.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import bpe, decode, numbers, text as T, timecode, tokens, wer
from ..operators import align, filters, joins, language, machine, mergeable, running, sampling, scoring, segments, tags
from ..session import scratch
from ..sinks import committed, outputs, tables
from ..sources import archives, transcripts
from ..streaming import sessions

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").withColumn("captions", T.lines(F.coalesce("text", F.lit(""))))


L = "(SELECT *, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"
W = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
KIND = "CASE WHEN trim(x) = '' OR (regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')) THEN 'mixed' WHEN regexp_matches(x, '[A-Z]') THEN 'upper' ELSE 'lower' END"
CASING = f"""(SELECT *, CASE
  WHEN (u = t)::INT + (lo = t)::INT + (m = t)::INT > 1 THEN CASE WHEN m = t THEN 'mixed' WHEN u = t THEN 'upper' ELSE 'lower' END
  WHEN m = t THEN 'mixed' WHEN lo = t THEN CASE WHEN m / lo > 0.6 THEN 'mixed' ELSE 'lower' END
  ELSE CASE WHEN m / u > 0.6 THEN 'mixed' ELSE 'upper' END END AS casing FROM (SELECT *, greatest(u, lo, m) AS t FROM (SELECT *,
    len(list_filter(k, lambda x: x = 'upper')) AS u, len(list_filter(k, lambda x: x = 'lower')) AS lo, len(list_filter(k, lambda x: x = 'mixed')) AS m
    FROM (SELECT *, list_transform(l, lambda x: {KIND}) AS k FROM {L}))))"""
REPEAT = f"len(list_filter(range(1, len(l)), lambda i: {W.format('l[i]')} > 1 AND {W.format('l[i + 1]')} > 1 AND contains(l[i + 1], l[i]))) > 0"
WORDS = f"CAST(list_sum(list_transform(l, lambda x: {W.format('x')})) AS BIGINT)"


@query(f"SELECT doc_id, CAST(i AS BIGINT) AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM {L})")
def q_lines(spark, sf_dir):
    docs = captioned(spark, sf_dir).select("doc_id", F.posexplode("captions").alias("i", "line"))
    return docs.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "line")


@query(f"SELECT doc_id, trim(array_to_string(list_transform(l, lambda x: trim(x)), ' ')) AS plain FROM {L}")
def q_extract_text(spark, sf_dir):
    return captioned(spark, sf_dir).select("doc_id", T.plain_text(F.col("captions")).alias("plain"))


@query(f"SELECT doc_id, {WORDS} AS num_words FROM {L}")
def q_word_count(spark, sf_dir):
    return tags.tag(captioned(spark, sf_dir), ["num_words"]).select("doc_id", "num_words")


@query(f"SELECT doc_id, u AS n_upper, lo AS n_lower, m AS n_mixed, casing FROM {CASING}")
def q_casing(spark, sf_dir):
    docs = captioned(spark, sf_dir).withColumn("c", T.casing_counts(F.col("captions")))
    return docs.select("doc_id", *(F.col(f"c.{k}").alias(f"n_{k}") for k in ("upper", "lower", "mixed")), T.casing(F.col("c")).alias("casing"))


@query(f"SELECT source, casing, count(*) AS n FROM {CASING} GROUP BY ALL")
def q_casing_stats(spark, sf_dir):
    return tags.tag(captioned(spark, sf_dir), ["casing"]).groupBy("source", "casing").agg(F.count("*").alias("n"))


@query("SELECT doc_id, contains(coalesce(text, ''), ',') AND contains(coalesce(text, ''), '.') AS has_comma_period FROM documents")
def q_comma_period(spark, sf_dir):
    return tags.tag(captioned(spark, sf_dir), ["has_comma_period"]).select("doc_id", "has_comma_period")


@query(f"SELECT doc_id, {REPEAT} AS repeating_lines FROM {L}")
def q_repeating_lines(spark, sf_dir):
    return tags.tag(captioned(spark, sf_dir), ["repeating_lines"]).select("doc_id", "repeating_lines")


@query(rf"SELECT doc_id, len(list_filter(range(1, len(l)), lambda i: regexp_matches(l[i], '[.!?]\s*$') AND regexp_matches(l[i + 1], '^\s*\p{{L}}') AND NOT regexp_matches(l[i + 1], '^\s*\p{{Lu}}'))) = 0 AS proper FROM {L}")
def q_proper_cap(spark, sf_dir):
    return captioned(spark, sf_dir).select("doc_id", T.capital_after_stop(F.col("captions")).alias("proper"))


@query(r"""SELECT page_id, c AS cleaned, c <> coalesce(html, '') AS changed FROM (SELECT *, regexp_replace(coalesce(html, ''),
'[ ]*(?:[A-Z][a-zA-Z]*[ ])+:[ ]*|[ ]*(?:&nbsp;|&amp;|&lt;|&gt;|=|\.{3}|\\h)+[ ]*', ' ', 'g') AS c FROM pages)""")
def q_text_clean(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    return load(spark, sf_dir, "pages").select("page_id", T.clean_caption(html).alias("cleaned"), (T.clean_caption(html) != html).alias("changed"))


DIALECT = r"""array_to_string(list_transform(list_filter(regexp_split_to_array(translate(text, '[]', '{}'), '\s+'), lambda w: w <> ''),
lambda w: CASE w WHEN 'busses' THEN 'buses' WHEN 'aks' THEN 'ask' WHEN 'aksing' THEN 'asking' WHEN 'aksed' THEN 'asked' ELSE w END), ' ')"""
for pattern in (r"(?i)/unintelligible/", r"(?i)/inaudible/", r"/RD(.*?)/", r"/\?+/", r" ?<[^>]+>", r" ?\([^)]+\)", r" ?\{[^}]+\}"):
    DIALECT = f"regexp_replace({DIALECT}, '{pattern}', '', 'g')"


@query(f"SELECT doc_id, {DIALECT} AS cleaned FROM documents")
def q_dialect_clean(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.clean_dialect(F.col("text")).alias("cleaned"))


@query("""SELECT doc_id, array_to_string(list_filter(t, lambda x, i: NOT contains(x, chr(10)) AND NOT (twice AND i <= 2)), ' ') AS document_text,
array_to_string(list_filter(t, lambda x, i: NOT contains(x, chr(10)) AND NOT (twice AND i = 2)), ' ') AS segment_text
FROM (SELECT doc_id, list_transform(c, lambda x, i: CASE WHEN i = len(c) THEN string_split(x, chr(10))[-1] ELSE x END) AS t, len(c) > 1 AND coalesce(c[1] = c[2], false) AS twice
FROM (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS c FROM documents))""")
def q_machine_text(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("c", F.split(F.coalesce("text", F.lit("")), r"\. ", -1))
    return docs.select("doc_id", T.machine_text(F.col("c"), False).alias("document_text"), T.machine_text(F.col("c"), True).alias("segment_text"))


COMMON = {k: ", ".join(f"'{w}'" for w in v) for k, v in T.COMMON_WORDS.items()}
COUNTED = ", ".join(f"len(list_filter(w, lambda x: x IN ({v}))) AS n_{k}" for k, v in COMMON.items())


@query(rf"""SELECT doc_id, CASE WHEN greatest(n_en, n_fr, n_de, n_es) = 0 OR n_en = greatest(n_en, n_fr, n_de, n_es) THEN 'en' WHEN n_fr = greatest(n_fr, n_de, n_es) THEN 'fr' WHEN n_de = greatest(n_de, n_es) THEN 'de' ELSE 'es' END AS text_lang
FROM (SELECT doc_id, {COUNTED} FROM (SELECT doc_id, string_split(regexp_replace(lower(trim(array_to_string(list_transform(l, lambda x: trim(x)), ' '))), '[^\p{{L}}'']+', ' ', 'g'), ' ') AS w FROM {L}))""")
def q_text_lang(spark, sf_dir):
    return tags.tag(captioned(spark, sf_dir), ["text_lang"]).select("doc_id", "text_lang")


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\[][^>\]]*[>\]]', '', 'g'), '\([^)]+\)', '', 'g'), '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g')) AS normal FROM conversations""")
def q_normalise(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalise(F.col("text")).alias("normal"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_lang_lookup(spark, sf_dir):
    return joins.lookup(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), "doc_id", "quality", -1)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_lang_missing(spark, sf_dir):
    return joins.missing(load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, event_type DESC) AS r
FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)) WHERE r = 1""")
def q_majority_vote(spark, sf_dir):
    return joins.majority(load(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def q_lang_distribution(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"))


STEPS = [
    {"tag": "lang", "ref_value": ["en", "de"]},
    {"tag": "casing", "ref_value": "lower", "comparison": "not_in"},
    {"tag": "repeating_lines", "reference_value": False},
    {"tag": "quality", "lower_bound": 1},
    {"tag": "num_words", "lower_bound": 50, "upper_bound": 5000, "inclusive": False},
]
HITS = f"""(SELECT d.*, CASE WHEN NOT coalesce(lang IN ('en', 'de'), true) THEN 'lang' WHEN casing = 'lower' THEN 'casing' WHEN {REPEAT} THEN 'repeating_lines'
  WHEN NOT coalesce(quality >= 1, true) THEN 'quality' WHEN NOT ({WORDS} > 50 AND {WORDS} < 5000) THEN 'num_words' ELSE 'pass' END AS hit
  FROM {CASING} d LEFT JOIN labels USING (doc_id))"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = captioned(spark, sf_dir).join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return filters.with_hit(tags.tag(docs, ["casing", "repeating_lines", "num_words"]), STEPS)


@query(f"SELECT doc_id, hit FROM {HITS}")
def q_filter_pipeline(spark, sf_dir):
    return hits(spark, sf_dir).select("doc_id", "hit")


@query(f"SELECT hit, count(*) AS n FROM {HITS} GROUP BY hit")
def q_hitlist(spark, sf_dir):
    return filters.hit_list(hits(spark, sf_dir))


@query(f"""SELECT step, hit, n, round(n / sum(n) OVER (), 6) AS of_all, round(n / (sum(n) OVER () - coalesce(sum(n) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS of_rest
FROM (SELECT CAST(coalesce(list_position(['lang', 'casing', 'repeating_lines', 'quality', 'num_words'], hit) - 1, 5) AS INTEGER) AS step, hit, count(*) AS n FROM {HITS} GROUP BY ALL)""")
def q_step_report(spark, sf_dir):
    return filters.step_report(hits(spark, sf_dir), STEPS)


@query(f"""SELECT *, round(rows_kept * 30 / 3600, 6) AS hours_kept, round(rows_kept / rows_in, 6) AS share_kept FROM (SELECT count(*) AS rows_in, count(*) FILTER (hit = 'pass') AS rows_kept,
CAST(sum(length(text)) AS BIGINT) AS chars_in, CAST(coalesce(sum(length(text)) FILTER (hit = 'pass'), 0) AS BIGINT) AS chars_kept FROM {HITS})""")
def q_survival(spark, sf_dir):
    return filters.survival(hits(spark, sf_dir))


@query(f"SELECT round(avg(n), 6) AS mean_kept, median(n) AS median_kept FROM (SELECT source, count(*) FILTER (hit = 'pass') AS n FROM {HITS} GROUP BY source)")
def q_kept_mean_median(spark, sf_dir):
    kept = hits(spark, sf_dir).groupBy("source").agg(F.sum((F.col("hit") == "pass").cast("long")).alias("n"))
    return kept.agg(F.round(F.avg("n"), 6).alias("mean_kept"), F.percentile("n", F.lit(0.5)).alias("median_kept"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10")
def q_subsample_per_shard(spark, sf_dir):
    return sampling.per_shard(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10)


@query("SELECT event_id, value FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 1000")
def q_reservoir(spark, sf_dir):
    return sampling.overall(load(spark, sf_dir, "events").select("event_id", "value"), "event_id", 1000)


@query("""SELECT CAST(p AS INTEGER) AS percentile, CASE WHEN p = 100 THEN s[n] ELSE s[CAST(least(round_even(p * n / 100.0, 0), n - 1) AS BIGINT) + 1] END AS value
FROM (SELECT list_sort(list(value)) AS s, count(value) AS n FROM events), range(0, 101) r(p)""")
def q_percentiles(spark, sf_dir):
    return sampling.percentiles(load(spark, sf_dir, "events"), "value", int(spark.conf.get("spark.sql.shuffle.partitions")))


@query(f"""SELECT source, tag, stat, value FROM (SELECT source, count(*) FILTER (casing = 'upper') AS a, count(*) FILTER (casing = 'lower') AS b, count(*) FILTER (casing = 'mixed') AS c,
count(*) FILTER ({REPEAT}) AS d, CAST(sum({WORDS}) AS BIGINT) AS e FROM {CASING} GROUP BY source),
LATERAL (VALUES ('casing', 'upper', a), ('casing', 'lower', b), ('casing', 'mixed', c), ('repeating_lines', 'count', d), ('num_words', 'total', e)) v(tag, stat, value)""")
def q_tag_stats(spark, sf_dir):
    return tags.tag_stats(tags.tag(captioned(spark, sf_dir), ["casing", "repeating_lines", "num_words"]), "source")


DAY_MS = "(epoch_us(ts) // 1000) % 86400000"
CODE = "printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000)"


def timed(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("ms", F.expr("unix_millis(cast(ts AS timestamp)) % 86400000"))


@query(f"SELECT event_id, {CODE} AS code, ms AS back, CASE WHEN ms >= 3600000 THEN ms - 3600000 ELSE -1 END AS since_one FROM (SELECT *, {DAY_MS} AS ms FROM events)")
def q_timecode_roundtrip(spark, sf_dir):
    code = timecode.from_ms(F.col("ms"))
    return timed(spark, sf_dir).select("event_id", code.alias("code"), timecode.to_ms(code).alias("back"), F.coalesce(timecode.difference(F.lit(3600000), F.col("ms")), F.lit(-1)).cast("long").alias("since_one"))


@query(f"SELECT event_id, CASE WHEN ms % 60000 <= 30000 THEN 50363 + (ms % 60000) // 20 ELSE -1 END AS token FROM (SELECT *, {DAY_MS} AS ms FROM events)")
def q_ts_token(spark, sf_dir):
    return timed(spark, sf_dir).select("event_id", F.coalesce(timecode.timestamp_token(F.col("ms") % 60000), F.lit(-1)).cast("long").alias("token"))


@query(f"SELECT event_id, 'u' || user_id AS base, round((ms // 10) / 100, 2) AS start_s FROM (SELECT *, {DAY_MS} AS ms FROM events)")
def q_utt_id_parse(spark, sf_dir):
    made = timed(spark, sf_dir).withColumn("utt_id", F.concat(F.lit("u"), "user_id", F.lit("-00000-"), F.lpad(F.expr("ms div 10").cast("string"), 8, "0"), F.lit("-00000000")))
    raw = F.regexp_extract("utt_id", r"-(\d{8})-\d{8}$", 1)
    return made.select("event_id", F.regexp_extract("utt_id", r"^(.*?)-\d{5}(?!\d)", 1).alias("base"), F.round(timecode.utterance_seconds(raw), 2).alias("start_s"))


@query(f"SELECT doc_id, list_reduce(list_transform(l, lambda x: [length(x), 1]), lambda a, b: CASE WHEN a[1] + b[1] <= 300 THEN [a[1] + b[1], a[2]] ELSE [b[1], a[2] + 1] END)[2] AS packs FROM {L}")
def q_pack_greedy(spark, sf_dir):
    return captioned(spark, sf_dir).select("doc_id", segments.pack_count(F.transform("captions", lambda c: F.length(c).cast("long")), 300).alias("packs"))


@query("""WITH u AS (SELECT conv_id, text AS ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, text AS hyp, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant'),
p AS (SELECT conv_id, n, u.ref, a.hyp FROM u FULL JOIN a USING (conv_id, n))
SELECT conv_id, CAST(n AS INTEGER) AS n, ref, coalesce(hyp, '') AS hyp FROM p WHERE conv_id NOT IN (SELECT conv_id FROM p WHERE ref IS NULL)""")
def q_pair_turns(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    return joins.pair_positions(turns.where("role = 'user'"), turns.where("role = 'assistant'"), "conv_id", "turn", "text")


NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '[<\[][^>\]]*[>\]]', '', 'g'), '\([^)]+\)', '', 'g'), '[^a-z0-9'' ]', ' ', 'g'), ' +', ' ', 'g'))"
SPLIT = "list_filter(string_split({}, ' '), lambda w: w <> '')"
# one row of costs after another: the row before, then what insertions make of it
EDITS = """list_reduce(list_prepend({{'w': '', 'c': range(0, len({h}) + 1)}}, list_transform({r}, lambda x: {{'w': x, 'c': CAST([] AS BIGINT[])}})),
lambda a, x: {{'w': '', 'c': list_transform([list_transform(a.c, lambda v, j: CASE WHEN j = 1 THEN v + 1 ELSE least(v + 1, a.c[j - 1] + CASE WHEN {h}[j - 1] = x.w THEN 0 ELSE 1 END) END)],
lambda d: list_transform(d, lambda v, j: list_min(list_transform(d[1:j], lambda y, k: y + j - k))))[1]}}).c[-1]"""
PAIRS = """(SELECT conv_id, n, ref, coalesce(hyp, '') AS hyp FROM (SELECT conv_id, CAST(n AS INTEGER) AS n, u.ref, a.hyp FROM
(SELECT conv_id, text AS ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') u FULL JOIN
(SELECT conv_id, text AS hyp, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') a USING (conv_id, n)) p
WHERE conv_id NOT IN (SELECT a.conv_id FROM (SELECT conv_id, count(*) AS k FROM conversations WHERE role = 'assistant' GROUP BY conv_id) a
LEFT JOIN (SELECT conv_id, count(*) AS k FROM conversations WHERE role = 'user' GROUP BY conv_id) u USING (conv_id) WHERE a.k > coalesce(u.k, 0)))"""
EDITED = f"""(SELECT conv_id, n, len(r) AS ref_words, {EDITS.format(r='r', h='h')} AS edits, len(h) AS hyp_words FROM
(SELECT conv_id, n, {SPLIT.format(NORMAL.format('ref'))} AS r, {SPLIT.format(NORMAL.format('hyp'))} AS h FROM {PAIRS}))"""
RATED = f"(SELECT *, CASE WHEN ref_words > 0 THEN edits / ref_words WHEN hyp_words = 0 THEN 0.0 END AS rate FROM {EDITED})"


@query(f"SELECT conv_id, n, ref_words, edits, round(rate, 6) AS wer, CASE WHEN rate = 0 THEN 'zero' WHEN rate = 1 THEN 'one' WHEN rate > 1 THEN 'over one' WHEN rate > 0 THEN 'between' END AS bucket FROM {RATED}")
def q_wer(spark, sf_dir):
    pairs = q_pair_turns(spark, sf_dir)
    ref, hyp = T.normalise(F.col("ref")), T.normalise(F.col("hyp"))
    rate = wer.wer(ref, hyp)
    return pairs.select("conv_id", "n", F.size(T.words(ref)).cast("long").alias("ref_words"), wer.word_edits(T.words(ref), T.words(hyp)).alias("edits"), F.round(rate, 6).alias("wer"), wer.bucket(rate).alias("bucket"))


@query(f"""SELECT CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(ref_words) AS BIGINT) AS ref_words, round(sum(edits) * 100 / sum(ref_words), 6) AS corpus_wer,
round(sum(round(rate, 6) * ref_words) / sum(ref_words), 6) AS weighted_wer FROM {RATED}""")
def q_wer_corpus(spark, sf_dir):
    pairs = q_wer(spark, sf_dir)
    return pairs.agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"), F.round(F.sum("edits") * 100 / F.sum("ref_words"), 6).alias("corpus_wer"), F.round(F.sum(F.col("wer") * F.col("ref_words")) / F.sum("ref_words"), 6).alias("weighted_wer"))


@query(f"""SELECT conv_id, n, round(CASE WHEN len(r) = 0 THEN 0.0 ELSE {EDITS.format(r='r', h='h')} / len(r) END, 6) AS edit_dist FROM (SELECT conv_id, n,
string_split(CASE WHEN nr <> '' THEN nr WHEN ref <> '' THEN ref WHEN nh <> '' THEN nh ELSE hyp END, ' ') AS r0, list_filter(r0, lambda w: w <> '') AS r,
list_filter(string_split(CASE WHEN nr <> '' OR ref <> '' THEN nh ELSE '' END, ' '), lambda w: w <> '') AS h
FROM (SELECT *, {NORMAL.format('ref')} AS nr, {NORMAL.format('hyp')} AS nh FROM (SELECT conv_id, n, CASE WHEN n % 3 = 0 THEN '' ELSE ref END AS ref, CASE WHEN n % 4 = 0 THEN '' ELSE hyp END AS hyp FROM {PAIRS})))""")
def q_edit_ladder(spark, sf_dir):
    """Every third reference and every fourth hypothesis empty, so that each step of the ladder is met."""
    blank = lambda c, k: F.when(F.col("n") % k == 0, "").otherwise(F.col(c)).alias(c)
    pairs = q_pair_turns(spark, sf_dir).select("conv_id", "n", blank("ref", 3), blank("hyp", 4))
    ladder = wer.distance_ladder(F.col("ref"), F.col("hyp"), T.normalise(F.col("ref")), T.normalise(F.col("hyp")))
    return pairs.select("conv_id", "n", F.round(ladder, 6).alias("edit_dist"))


def scored_pairs(spark, sf_dir, kinds=False):
    pairs = q_pair_turns(spark, sf_dir).withColumns({"ref": T.normalise(F.col("ref")), "hyp": T.normalise(F.col("hyp"))})
    return scoring.pair_scores(scoring.valid_references(pairs), F.col("ref"), F.col("hyp"), kinds)


# rows of cells with their costs, substitutions and deletions; where insertions lead to a cell, it has those of the last of the least costs less places before it
SDI = """list_reduce(list_prepend({{'w': '', 'p': list_transform(range(0, len({h}) + 1), lambda x: {{'c': x, 's': CAST(0 AS BIGINT), 'd': CAST(0 AS BIGINT)}})}},
list_transform({r}, lambda x: {{'w': x, 'p': CAST([] AS STRUCT(c BIGINT, s BIGINT, d BIGINT)[])}})), lambda a, x: {{'w': '', 'p': list_transform([list_transform(a.p, lambda v, j:
CASE WHEN j > 1 AND a.p[j - 1].c + (CASE WHEN {h}[j - 1] = x.w THEN 0 ELSE 1 END) <= v.c + 1
THEN {{'b': a.p[j - 1].c + (CASE WHEN {h}[j - 1] = x.w THEN 0 ELSE 1 END), 's': a.p[j - 1].s + (CASE WHEN {h}[j - 1] = x.w THEN 0 ELSE 1 END), 'd': a.p[j - 1].d}} ELSE {{'b': v.c + 1, 's': v.s, 'd': v.d + 1}} END)],
lambda t: list_transform(list_transform(t, lambda v, j: list_max(list_transform(t[1:j], lambda y, k: {{'m': k - y.b, 'k': k, 's': y.s, 'd': y.d}}))), lambda z, j: {{'c': j - z.m, 's': z.s, 'd': z.d}}))[1]}}).p[-1]"""


@query(f"""SELECT conv_id, n, ref_words, e.s AS subs, e.d AS dels, e.c - e.s - e.d AS ins FROM (SELECT conv_id, n, len(r) AS ref_words, {SDI.format(r='r', h='h')} AS e
FROM (SELECT conv_id, n, {SPLIT.format(NORMAL.format('ref'))} AS r, {SPLIT.format(NORMAL.format('hyp'))} AS h FROM {PAIRS})) WHERE ref_words > 0""")
def q_sdi(spark, sf_dir):
    """Substitutions, deletions and insertions of each pair; matches and substitutions go before deletions, these before insertions, seen from the end."""
    return scored_pairs(spark, sf_dir, kinds=True).select("conv_id", "n", "ref_words", "subs", "dels", "ins")


@query(f"""SELECT CAST(conv_id % 3 AS INTEGER) AS eval_set, count(*) AS pairs, CAST(sum(ref_words) AS BIGINT) AS ref_words, CAST(sum(edits) AS BIGINT) AS edits, round(sum(edits) * 100 / sum(ref_words), 6) AS wer,
round(sum(rate * ref_words) / sum(ref_words), 6) AS by_words FROM {RATED} WHERE ref_words > 0 GROUP BY ALL""")
def q_scores_by_set(spark, sf_dir):
    found = scoring.corpus_scores(scored_pairs(spark, sf_dir).withColumn("eval_set", (F.col("conv_id") % 3).cast("int")), ["eval_set"])
    return found.select("eval_set", "pairs", "ref_words", "edits", F.round("wer", 6).alias("wer"), F.round("by_words", 6).alias("by_words"))


@query(f"SELECT count(*) AS sets, round(avg(wer), 6) AS mean, round(min(wer), 6) AS best FROM (SELECT sum(edits) * 100 / sum(ref_words) AS wer FROM {RATED} WHERE ref_words > 0 GROUP BY conv_id % 3)")
def q_scores_over_sets(spark, sf_dir):
    found = scoring.over_sets(scoring.corpus_scores(scored_pairs(spark, sf_dir).withColumn("eval_set", F.col("conv_id") % 3), ["eval_set"]))
    return found.select("sets", F.round("mean", 6).alias("mean"), F.round("best", 6).alias("best"))


@query(f"SELECT conv_id, n, r AS ref FROM (SELECT conv_id, n, {NORMAL.format('ref')} AS r FROM {PAIRS}) WHERE r <> '' AND r <> 'ignore time segment in scoring'")
def q_eval_valid(spark, sf_dir):
    pairs = q_pair_turns(spark, sf_dir).select("conv_id", "n", T.normalise(F.col("ref")).alias("ref"))
    return scoring.valid_references(pairs)


@query()
def q_overall_bars(spark, sf_dir):
    """Error bars over three sets taken together, and of the plain mean over all pairs."""
    scored = scored_pairs(spark, sf_dir).withColumn("eval_set", F.col("conv_id") % 3)
    named = lambda bars, name: bars.withColumn("kind", F.lit(name))
    return named(scoring.overall_bars(scored, "eval_set", ["conv_id", "n"]), "weighted").unionByName(named(scoring.unweighted_bars(scored, ["conv_id", "n"]), "plain"))


@query("SELECT event_id, (value / 100 > 0.6 AND NOT value / 10 - 8 > -1.0) AS skipped FROM events")
def q_skip_rule(spark, sf_dir):
    v = F.col("value")
    return load(spark, sf_dir, "events").select("event_id", decode.skipped(v / 100, v / 10 - 8).alias("skipped"))


@query(f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_ids, len(t) > 448 AS over_length, array_to_string(list_concat(t, list_transform(range(greatest(0, 448 - len(t))), lambda i: 51864)), ',') AS text_input,
array_to_string(list_concat(t[2:], list_transform(range(greatest(0, 449 - len(t))), lambda i: 51864)), ',') AS text_y
FROM (SELECT doc_id, list_concat([50257], list_transform(list_filter(regexp_split_to_array(array_to_string(l, ' '), '\\s+'), lambda w: w <> ''), lambda w: length(w)), [50256]) AS t FROM {L})""")
def q_token_seq(spark, sf_dir):
    """All ids of each text as one sequence, padded to 448; longer ones stay whole and are marked."""
    ids = F.transform(T.words(F.array_join("captions", " ")), lambda w: F.length(w))
    seq = F.concat(F.array(F.lit(50257)), ids, F.array(F.lit(50256)))
    docs = captioned(spark, sf_dir).select("doc_id", seq.alias("t"))
    pad = lambda n: F.array_repeat(F.lit(51864), F.greatest(n - F.size("t"), F.lit(0)))
    return docs.select(
        "doc_id", F.size("t").cast("long").alias("n_ids"), (F.size("t") > 448).alias("over_length"),
        F.array_join(F.concat("t", pad(F.lit(448))), ",").alias("text_input"), F.array_join(F.concat(F.slice("t", F.lit(2), F.size("t")), pad(F.lit(449))), ",").alias("text_y"))


@query(f"""SELECT doc_id, CAST(w AS INTEGER) AS window_no, array_to_string(list_concat(t, list_transform(range(448 - len(t)), lambda i: 51864)), ',') AS text_input, array_to_string(list_concat(t[2:], list_transform(range(449 - len(t)), lambda i: 51864)), ',') AS text_y
FROM (SELECT doc_id, w, list_concat([50257], ids[w * 446 + 1:w * 446 + 446], [50256]) AS t FROM (SELECT doc_id, ids, unnest(range(greatest(1, (len(ids) + 445) // 446))) AS w
FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(array_to_string(l, ' '), '\\s+'), lambda w: w <> ''), lambda w: length(w)) AS ids FROM {L})))""")
def q_token_windows(spark, sf_dir):
    """All words of each text as consecutive sequences of at most 446 ids."""
    ids = F.transform(T.words(F.array_join("captions", " ")), lambda w: F.length(w))
    cut = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(446)), lambda at: F.slice(v, at, F.lit(446)))
    # bound as a lambda variable, so that words are made once a row
    windows = F.transform(F.array(ids), cut)[0]
    docs = captioned(spark, sf_dir).select("doc_id", F.posexplode(windows).alias("window_no", "part"))
    docs = docs.select("doc_id", "window_no", F.concat(F.array(F.lit(50257)), "part", F.array(F.lit(50256))).alias("t"))
    pad = lambda n: F.array_repeat(F.lit(51864), n - F.size("t"))
    return docs.select("doc_id", "window_no", F.array_join(F.concat("t", pad(F.lit(448))), ",").alias("text_input"), F.array_join(F.concat(F.slice("t", 2, 448), pad(F.lit(449))), ",").alias("text_y"))


#: Poisson(1) chances of at most k, in units of 2 ** -24, as far as draws of 24 bits can tell them apart.
AT_MOST = [math.ceil(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**24) for k in range(10)]


@query(f"""WITH w AS (SELECT value, b, CAST('0x' || substr(md5(b || '|' || event_id), 1, 6) AS BIGINT) AS h FROM events, range(0, 20) r(b)),
p AS (SELECT b, value, {" + ".join(f"(h >= {c})::INT" for c in AT_MOST)} AS k FROM w)
SELECT CAST(b AS INTEGER) AS b, round(sum(value * k) / sum(k), 6) AS mean FROM p GROUP BY b""")
def q_bootstrap_det(spark, sf_dir):
    drawn = load(spark, sf_dir, "events").select("event_id", "value", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("b"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "b", "event_id")), 1, 6), 16, 10).cast("long")
    k = sum((h >= c).cast("int") for c in AT_MOST)
    return drawn.groupBy("b").agg(F.round(F.sum(F.col("value") * k) / F.sum(k), 6).alias("mean"))


@query()
def q_bootstrap(spark, sf_dir):
    """Error bars of the word error rate in percent, weighted by reference words, from 1,000 resamples."""
    means = sampling.bootstrap_means(q_wer(spark, sf_dir), ["conv_id", "n"], "wer", "ref_words")
    return sampling.error_bars(means.withColumn("mean", F.col("mean") * 100))


@query("SELECT user_id, event_id, CAST(gap_ms AS BIGINT) AS gap_ms, gap_ms // 30000 AS full_windows, gap_ms % 30000 AS rest_ms FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_ms FROM events) WHERE gap_ms >= 30000")
def q_gap_segments(spark, sf_dir):
    ms = F.expr("unix_millis(cast(ts AS timestamp))")
    rows = load(spark, sf_dir, "events").withColumn("ms", ms)
    gap = F.col("ms") - F.lag("ms").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.withColumn("gap_ms", gap).where("gap_ms >= 30000").select("user_id", "event_id", "gap_ms", F.expr("gap_ms div 30000").alias("full_windows"), (F.col("gap_ms") % 30000).alias("rest_ms"))


def placed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(id, captions) of rows (key, order, d, gap, text): each caption starts ``gap`` ms after the one before and takes ``d``."""
    end = F.sum(F.col("d") + F.col("gap")).over(Window.partitionBy(key).orderBy(order))
    spans = rows.select(F.col(key).cast("string").alias("id"), order, (end - F.col("d")).alias("start"), end.alias("end"), "text")
    whole = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order, "start", "end", "text"))).alias("c"))
    return whole.select("id", F.transform("c", lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), c.text.alias("text"))).alias("captions"))


#: Windows ``w`` (doc_id, i, part, start, end, first and last caption; none in silence) of captions ``c`` (doc_id, i from 1, s, e, text) of ``docs``; ``r`` also has the captions that are too long.
SEGMENTING = """-- caption after caption: where the window starts, its first caption (0: none), its last end; the speech that a caption closes, and the silence before it
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pos, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS upto, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c1, CAST(0 AS BIGINT) AS quiet, CAST(0 AS BIGINT) AS n_full, CAST(NULL AS BIGINT) AS rest_at, CAST(NULL AS BIGINT) AS rest_end, CAST(0 AS BIGINT) AS long FROM docs
  UNION ALL SELECT doc_id, i, CASE WHEN is_long THEN e WHEN silent AND (rest OR gap <= 0) THEN s ELSE at3 END, CASE WHEN is_long THEN 0 WHEN held2 = 0 THEN i ELSE held2 END, e, a, b, c1, at2, n_full, CASE WHEN rest THEN at3 END, CASE WHEN rest THEN s END, is_long::BIGINT
  FROM (SELECT *, at2 + n_full * 30000 AS at3, silent AND (CASE WHEN gap >= 30000 THEN e - (at2 + n_full * 30000) > 30000 ELSE gap > 0 END) AS rest
  FROM (SELECT *, CASE WHEN silent AND gap >= 30000 THEN gap // 30000 ELSE 0 END AS n_full
  FROM (SELECT *, NOT is_long AND held2 = 0 AND e - at2 > 30000 AS silent, s - at2 AS gap
  FROM (SELECT doc_id, i, s, e, is_long, CASE WHEN closes THEN at1 END AS a, CASE WHEN closes THEN upto END AS b, CASE WHEN closes THEN first END AS c1, CASE WHEN closes AND NOT is_long THEN upto ELSE at1 END AS at2, CASE WHEN closes THEN 0 ELSE first END AS held2
  FROM (SELECT c.doc_id, c.i, c.s, c.e, c.e - c.s > 30000 AS is_long, coalesce(r.pos, c.s) AS at1, r.first, r.upto, r.first > 0 AND (c.e - c.s > 30000 OR c.e - coalesce(r.pos, c.s) > 30000) AS closes
    FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1)))))),
w AS (SELECT doc_id, i, 0 AS part, a AS s, b AS e, c1, i - 1 AS c2 FROM r WHERE c1 IS NOT NULL
  UNION ALL SELECT doc_id, i, 1 + k, quiet + k * 30000, quiet + (k + 1) * 30000, NULL, NULL FROM (SELECT doc_id, i, quiet, unnest(range(0, n_full)) AS k FROM r WHERE n_full > 0)
  UNION ALL SELECT doc_id, i, 1000000, rest_at, rest_end, NULL, NULL FROM r WHERE rest_at IS NOT NULL
  UNION ALL SELECT doc_id, i + 1, 0, pos, upto, first, i FROM (SELECT *, i = max(i) OVER (PARTITION BY doc_id) AS final FROM r) WHERE final AND first > 0)"""


@query(f"""WITH RECURSIVE docs AS (SELECT doc_id FROM documents), t AS (SELECT doc_id, i - 1 AS i, l[i] AS text, length(l[i]) * 120 AS d, CASE WHEN (i - 1) % 7 = 6 THEN 40000 ELSE 0 END AS gap FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM {L})),
z AS (SELECT doc_id, i, text, CAST(sum(d + gap) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e, d FROM t),
-- captions of the same times are one, with the last text
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS i, e - d AS s, e, arg_max(text, i) AS text FROM z GROUP BY doc_id, e - d, e),
{SEGMENTING},
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS seg_id FROM w)
SELECT CAST(doc_id AS VARCHAR) AS id, seg_id, s AS start_ms, e - s AS length_ms, CASE WHEN c1 IS NULL THEN 0 ELSE c2 - c1 + 1 END AS n_captions,
  coalesce((SELECT string_agg(c.text, chr(10) ORDER BY c.i) FROM c WHERE c.doc_id = k.doc_id AND c.i BETWEEN k.c1 AND k.c2), '') AS text, c1 IS NULL AS silent, '' AS reason FROM k WHERE seg_id < 120
UNION ALL SELECT CAST(doc_id AS VARCHAR), -1, -1, -1, 0, '', false, 'no segment, ' || CAST(sum(long) AS BIGINT) || ' long captions' FROM r WHERE doc_id NOT IN (SELECT doc_id FROM k) GROUP BY doc_id""")
def q_segments(spark, sf_dir):
    """Captions of made-up length (120 ms a character) with a pause before every seventh one."""
    rows = captioned(spark, sf_dir).select("doc_id", F.posexplode("captions").alias("i", "text"))
    timed_rows = rows.withColumns({"d": (F.length("text") * 120).cast("long"), "gap": F.when(F.col("i") % 7 == 6, 40000).otherwise(0).cast("long")})
    found = segments.segments(placed(timed_rows, "doc_id", "i"))
    none = {"seg_id": -1, "start_ms": -1, "length_ms": -1, "n_captions": 0, "text": "", "silent": False, "reason": ""}
    return found.select("id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()))


SHIFTED = "CASE WHEN ms - 7200000 < 0 THEN ms - 7200000 + 86400000 ELSE ms - 7200000 END"


@query(f"SELECT event_id, ms - 7200000 AS plain, {SHIFTED} AS wrapped, printf('%02d:%02d:%02d.%03d', w // 3600000, (w // 60000) % 60, (w // 1000) % 60, w % 1000) AS code FROM (SELECT *, {SHIFTED} AS w FROM (SELECT *, {DAY_MS} AS ms FROM events))")
def q_tc_shift(spark, sf_dir):
    by = F.lit(-7200000)
    wrapped = timecode.shift(F.col("ms"), by, wrap=True)
    return timed(spark, sf_dir).select("event_id", timecode.shift(F.col("ms"), by).alias("plain"), wrapped.alias("wrapped"), timecode.from_ms(wrapped).alias("code"))


@query(f"SELECT event_id, CASE WHEN ms >= before THEN ms - before ELSE -1 END AS gap FROM (SELECT event_id, ms, lag(ms, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT *, {DAY_MS} AS ms FROM events))")
def q_tc_diff(spark, sf_dir):
    before = F.lag("ms", 1, 0).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = timed(spark, sf_dir).withColumn("before", before)
    return rows.select("event_id", F.coalesce(timecode.difference(F.col("before"), F.col("ms")), F.lit(-1)).cast("long").alias("gap"))


@query(f"""SELECT doc_id, t + 2 * len(l) + CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END + 2 AS num_tokens_ts_mode, t + 3 AS num_tokens_no_ts_mode,
t + 2 * len(l) + CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END + 2 <= 448 AS ts_mode, t + 3 <= 448 AS no_ts_mode, t + 2 * len(l) + CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END + 2 > 448 AND t + 3 > 448 AS over
FROM (SELECT doc_id, l, {WORDS} AS t FROM {L})""")
def q_ctx_len(spark, sf_dir):
    docs = captioned(spark, sf_dir)
    return docs.select("doc_id", tokens.context_modes(F.col("captions"), F.col("doc_id") % 2 == 1).alias("k")).select("doc_id", "k.*")


def spans_by_hour(spark, sf_dir):
    """The events of a user and hour as spans (start, end) in order, value x 100 ms long."""
    rows = timed(spark, sf_dir).withColumn("hour", F.expr("ms div 3600000"))
    spans = F.array_sort(F.collect_list(F.struct("event_id", F.col("ms").alias("start"), (F.col("ms") + F.floor(F.col("value") * 100)).alias("end"), "event_type", "value")))
    return rows.groupBy("user_id", "hour").agg(spans.alias("spans"))


SPANS = f"(SELECT user_id, ms // 3600000 AS hour, list({{'s': ms, 'e': ms + CAST(floor(value * 100) AS BIGINT), 't': event_type, 'v': value}} ORDER BY event_id) AS p FROM (SELECT *, {DAY_MS} AS ms FROM events) GROUP BY ALL)"


@query(f"""SELECT user_id, hour, p[1].s >= hour * 3600000 AND p[-1].e <= (hour + 1) * 3600000 AND len(list_filter(p, lambda x: x.s > x.e OR x.s < p[1].s OR x.e > p[-1].e OR x.s < hour * 3600000 OR x.e > (hour + 1) * 3600000)) = 0 AS valid FROM {SPANS}""")
def q_ts_valid(spark, sf_dir):
    start = F.col("hour") * 3600000
    return spans_by_hour(spark, sf_dir).select("user_id", "hour", tokens.times_valid(F.col("spans"), start, start + 3600000).alias("valid"))


@query("SELECT event_id, value < 15 AS short_span, value * 100 / 16000 < 0.015 AS short_audio FROM events")
def q_too_short(spark, sf_dir):
    zero = F.lit(0)
    return load(spark, sf_dir, "events").select("event_id", tokens.too_short(zero, F.col("value")).alias("short_span"), tokens.too_short_audio(F.col("value") * 100).alias("short_audio"))


@query("SELECT event_id, (value / 20 > 2.4 OR -value / 50 < -1.0) AND NOT (value / 100 > 0.6 AND -value / 50 < -1.0) AS falls_back FROM events")
def q_fallback(spark, sf_dir):
    v = F.col("value")
    return load(spark, sf_dir, "events").select("event_id", decode.falls_back(v / 20, -v / 50, v / 100).alias("falls_back"))


@query("""SELECT user_id, coalesce(min(event_id) FILTER (NOT bad), max(event_id)) AS event_id FROM
(SELECT *, (value / 20 > 2.4 OR -value / 50 < -1.0) AND NOT (value / 100 > 0.6 AND -value / 50 < -1.0) AS bad FROM events) GROUP BY user_id""")
def q_first_attempt(spark, sf_dir):
    v = F.col("value")
    attempts = load(spark, sf_dir, "events").select("user_id", "event_id", (v / 20).alias("compression_ratio"), (-v / 50).alias("avg_logprob"), (v / 100).alias("no_speech_prob"))
    return decode.first_good_attempt(attempts, "user_id", "event_id").select("user_id", "event_id")


@query(f"""SELECT user_id, hour, round(score, 6) AS score, score >= 3 OR score + 0.01 >= n AS odd FROM (SELECT user_id, hour, len(w) AS n, list_sum(list_transform(w, lambda x: CASE WHEN x.v / 100 < 0.15 THEN 1.0 ELSE 0.0 END
+ CASE WHEN x.v / 40 < 0.133 THEN (0.133 - x.v / 40) * 15 ELSE 0.0 END + CASE WHEN x.v / 40 > 2.0 THEN x.v / 40 - 2.0 ELSE 0.0 END)) AS score FROM (SELECT user_id, hour, p[1:8] AS w FROM {SPANS}))""")
def q_anomaly(spark, sf_dir):
    words = F.transform("spans", lambda x: F.struct(x.event_type.alias("word"), F.lit(0.0).alias("start"), (x.value / 40).alias("end"), (x.value / 100).alias("probability")))
    rows = spans_by_hour(spark, sf_dir).withColumn("w", words)
    score = F.aggregate(F.slice("w", 1, decode.FIRST_WORDS), F.lit(0.0), lambda s, w: s + decode.word_score(w))
    return rows.select("user_id", "hour", F.round(score, 6).alias("score"), decode.segment_odd(F.col("w")).alias("odd"))


CHUNK_TEXT = "CASE WHEN event_id % 17 = 0 THEN ' you' WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 3 = 0 THEN event_type || ' foreign' ELSE event_type END"


@query(f"""SELECT user_id, len(k) AS chunks, array_to_string(list_transform(k, lambda x, i: CASE WHEN i = len(k) THEN regexp_replace(x, '\\s*foreign\\s*$', '') ELSE x END), '|') AS text FROM (
SELECT user_id, list_filter(CASE WHEN list_position(c, 'you') > 0 THEN c[1:list_position(c, 'you') - 1] ELSE c END, lambda x: x <> '') AS k
FROM (SELECT user_id, list(trim({CHUNK_TEXT}) ORDER BY event_id) AS c FROM events GROUP BY user_id))""")
def q_takewhile(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("text", F.expr(CHUNK_TEXT))
    kept = running.spoken(rows.select("user_id", "event_id", "text"), "user_id", "event_id", decode.FILLER)
    told = kept.groupBy("user_id").agg(F.count("*").alias("chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "text"))), lambda c: c.text), "|").alias("text"))
    users = rows.select("user_id").distinct()
    return users.join(told, "user_id", "left").select("user_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"""SELECT event_id, round(s + o, 3) AS start_s, round(e + o, 3) AS end_s FROM (SELECT *, coalesce(sum(CASE WHEN s < before THEN before - zero ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS o FROM (
SELECT event_id, user_id, s, e, lag(e) OVER (PARTITION BY user_id ORDER BY event_id) AS before, first_value(s) OVER (PARTITION BY user_id ORDER BY event_id) AS zero
FROM (SELECT event_id, user_id, (ms % 100000) / 1000 AS s, (ms % 100000) / 1000 + 2.0 AS e FROM (SELECT *, {DAY_MS} AS ms FROM events))))""")
def q_offset_reset(spark, sf_dir):
    s = (F.col("ms") % 100000) / 1000
    rows = timed(spark, sf_dir).select("user_id", "event_id", s.alias("start"), (s + 2.0).alias("end"))
    found = running.running_times(rows, "user_id", "event_id")
    return found.select("event_id", F.round("start", 3).alias("start_s"), F.round("end", 3).alias("end_s"))


TOKEN = "CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 50363 + event_id % 1500 ELSE event_id % 50000 END"


@query(f"""WITH t AS (SELECT user_id, list(CAST({TOKEN} AS INTEGER) ORDER BY event_id) AS t FROM events GROUP BY user_id),
c AS (SELECT *, list_filter(range(2, len(t) + 1), lambda i: t[i] >= 50363 AND t[i - 1] >= 50363) AS inner_cuts, len(t) > 1 AND t[-1] >= 50363 AND t[-2] < 50363 AS single FROM t),
d AS (SELECT *, CASE WHEN len(inner_cuts) > 0 AND single THEN list_append(inner_cuts, len(t) + 1) ELSE inner_cuts END AS cuts FROM c),
u AS (SELECT user_id, t, cuts, unnest(range(1, greatest(len(cuts), 1) + 1)) AS k FROM d),
v AS (SELECT *, CASE WHEN len(cuts) = 0 THEN 1 WHEN k = 1 THEN 1 ELSE cuts[k - 1] END AS a, CASE WHEN len(cuts) = 0 THEN len(t) + 1 ELSE cuts[k] END AS b FROM u)
SELECT user_id, CAST(k - 1 AS INTEGER) AS k, CASE WHEN len(cuts) = 0 THEN 0 ELSE t[a] - 50363 END AS start_at,
coalesce(CASE WHEN len(cuts) = 0 THEN nullif(list_filter(t, lambda x: x >= 50363)[-1] - 50363, 0) ELSE t[b - 1] - 50363 END, -1) AS end_at, CAST(b - a AS INTEGER) AS n_tokens FROM v""")
def q_time_slices(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("t", F.expr(TOKEN).cast("int"))
    cut = running.time_slices(rows, "user_id", "event_id", "t")
    return cut.select("user_id", "k", F.col("start").alias("start_at"), F.coalesce("end", F.lit(-1)).alias("end_at"), "n_tokens")


@query("SELECT event_id, round(CASE WHEN event_id < 20 THEN event_id / 20 ELSE greatest(0.0, (10000 - event_id) / 9980) END, 9) AS rate FROM events")
def q_learning_rate(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(decode.learning_rate(F.col("event_id"), 10000), 9).alias("rate"))


@query("""SELECT vec_id, round(list_sum(m), 4) AS total, round(list_max(p), 4) AS top, len(f) AS n FROM (SELECT vec_id, m,
list_transform(m, lambda x: CASE WHEN list_max(list_transform(m, lambda y: abs(y))) > 0 THEN x / list_max(list_transform(m, lambda y: abs(y))) ELSE x END) AS p, list_concat(m[1:40], list_transform(range(greatest(0, 40 - len(m))), lambda i: 0.0)) AS f
FROM (SELECT vec_id, list_transform(embedding, lambda x, i: (CAST(x AS DOUBLE) + CAST(embedding[len(embedding) + 1 - i] AS DOUBLE)) / 2) AS m FROM embeddings))""")
def q_audio_arrays(spark, sf_dir):
    """Vectors and their mirror images as the channels of a recording: mean, peak, cut to a length."""
    left = F.transform("embedding", lambda x: x.cast("double"))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", decode.mono(F.array(left, F.reverse(left))).alias("m"))
    return rows.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.array_max(decode.peak_normalised(F.col("m"))), 4).alias("top"), F.size(decode.trimmed_audio(F.col("m"), 40)).cast("long").alias("n"))


@query("SELECT doc_id, lang, -1 AS quality FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '' AS lang, quality FROM labels WHERE doc_id % 2 = 1")
def q_union_shards(spark, sf_dir):
    a = load(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", "lang")
    both = align.shard_union(a, load(spark, sf_dir, "labels").where("doc_id % 2 = 1").select("doc_id", "quality"))
    return both.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query("SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_map_merge(spark, sf_dir):
    """Two language maps; of an id in both the later map wins."""
    a = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.lit("map-1").alias("f"))
    b = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("labelled").alias("lang"), F.lit("map-2").alias("f"))
    return joins.merge_maps(align.shard_union(a, b))


@query(f"SELECT d.doc_id, '{{\"num_words\":' || {WORDS} || ',\"repeating_lines\":' || CASE WHEN {REPEAT} THEN 'true' ELSE 'false' END || '}}' AS tags FROM {L} d")
def q_tag_map(spark, sf_dir):
    return tables.tag_map(tags.tag(captioned(spark, sf_dir), ["num_words", "repeating_lines"]), "doc_id", ["num_words", "repeating_lines"])


@query(f"""WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (casing = 'upper') AS upper_count, CAST(sum(n_chars) FILTER (casing = 'upper') AS DOUBLE) AS upper_dur, CAST(sum({WORDS}) AS DOUBLE) AS words FROM {CASING} GROUP BY source)
SELECT 'casing' AS tag, 'upper_avg' AS stat, round(sum(upper_count) / sum(n), 6) AS value FROM s UNION ALL SELECT 'casing', 'upper_dur', round(coalesce(sum(upper_dur), 0), 6) FROM s UNION ALL SELECT 'num_words', 'words', round(sum(words), 6) FROM s""")
def q_tag_rollup(spark, sf_dir):
    tagged = tags.tag(captioned(spark, sf_dir), ["casing", "num_words"])
    upper = F.col("casing") == "upper"
    stats = {"upper_count": ("casing", upper.cast("long")), "upper_dur": ("casing", F.when(upper, F.col("n_chars"))), "words": ("num_words", F.col("num_words"))}
    return tags.rolled_up(tags.stat_rows(tagged, stats, "source")).select("tag", "stat", F.round("value", 6).alias("value"))


CUE = r"rtrim(regexp_replace(regexp_replace(x, '<[^<>]*>', '', 'g'), '\r', '', 'g'))"
AT = "printf('%02d:%02d:%02d.%03d', ({0}) // 3600000, (({0}) // 60000) % 60, (({0}) // 1000) % 60, ({0}) % 1000)"
CLEANED = r"regexp_replace({0}, '[ ]*(?:[A-Z][a-zA-Z]*[ ])+:[ ]*|[ ]*(?:&nbsp;|&amp;|&lt;|&gt;|=|\.{{3}}|\\h)+[ ]*', ' ', 'g')".format(CUE)


def subtitled(spark, sf_dir):
    """Documents whose lines are captions two seconds apart, as subtitle files."""
    times = F.transform("captions", lambda c, i: F.struct((i * 2000).cast("long").alias("start"), (i * 2000 + 1500).cast("long").alias("end"), c.alias("text")))
    return captioned(spark, sf_dir).withColumn("seg_content", transcripts.write_subtitles(times, F.lit(0).cast("long")))


@query(f"""SELECT doc_id, CASE WHEN lang = 'en' THEN 'pass' ELSE 'lang' END AS hit, 'WEBVTT' || chr(10) || chr(10) || array_to_string(list_transform(l, lambda x, i: {AT.format('(i - 1) * 2000')} || ' --> ' || {AT.format('(i - 1) * 2000 + 1500')} || chr(10)
|| {CLEANED} || chr(10) || chr(10)), '') AS seg_content FROM {L}""")
def q_seg_clean(spark, sf_dir):
    """The cleaning step in a filter pipeline, on all captions of each document."""
    return filters.with_hit(subtitled(spark, sf_dir), [{"tag": "lang", "ref_value": ["en"]}, {"tag": "seg_content"}]).select("doc_id", "hit", "seg_content")


@query(f"SELECT doc_id, trim(array_to_string(list_transform(l, lambda x: trim({CUE})), ' ')) AS seg_text FROM {L}")
def q_seg_text(spark, sf_dir):
    """Texts read from subtitle files."""
    return subtitled(spark, sf_dir).select("doc_id", transcripts.segment_text(F.col("seg_content")).alias("seg_text"))


@query(f"""SELECT CAST(conv_id % 3 AS INTEGER) AS eval_set, CAST(sum(chars) AS BIGINT) AS chars, round(sum(edits / words * chars) / sum(chars), 6) AS by_chars FROM (SELECT conv_id, length(r) AS chars,
len({SPLIT.format('r')}) AS words, {EDITS.format(r=SPLIT.format('r'), h=SPLIT.format('h'))} AS edits FROM (SELECT conv_id, {NORMAL.format('ref')} AS r, {NORMAL.format('hyp')} AS h FROM {PAIRS}) WHERE r <> '') GROUP BY ALL""")
def q_scores_by_chars(spark, sf_dir):
    """Mean rates weighted by the reference's characters."""
    scored = scored_pairs(spark, sf_dir).withColumn("eval_set", (F.col("conv_id") % 3).cast("int"))
    chars = scored.groupBy("eval_set").agg(F.sum("ref_chars").alias("chars"))
    return scoring.corpus_scores(scored, ["eval_set"]).join(chars, "eval_set").select("eval_set", "chars", F.round("by_chars", 6).alias("by_chars"))


SEQ = """SELECT doc_id, CASE WHEN n = 0 THEN [50257, 50362, 50256] WHEN timed AND NOT bare AND ne <= 30000 THEN list_concat(list_concat([50257], flatten(list_transform(c, lambda x, i: list_concat(list_concat([50363 + (i - 1) * 100], x), [50363 + (i - 1) * 100 + 75])))), [50363 + ne // 20, 50256])
ELSE list_concat(list_concat([50257, 50362], flatten(own)), [50256]) END AS t FROM (SELECT *, CASE WHEN ne > 30000 AND n > 1 THEN c[1:n - 1] ELSE c END AS own FROM (SELECT doc_id, doc_id % 3 = 0 AS bare, substr(md5('42|' || doc_id), 1, 1) < '8' AS timed, len(l) AS n, len(l) * 2000 AS ne,
list_transform(l, lambda x: list_transform(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''), lambda w: length(w))) AS c FROM """ + L + "))"


@query(f"SELECT doc_id, len(t) AS n_ids, array_to_string(t, ',') AS ids, len(t) - 1 > 448 AS too_long FROM ({SEQ})")
def q_token_modes(spark, sf_dir):
    """Captions two seconds apart, word lengths for ids, a draw fixed by the id."""
    ids = lambda c: F.transform(T.words(c), lambda w: F.length(w))
    own = F.transform("captions", lambda c, i: F.struct((i * 2000).alias("start"), (i * 2000 + 1500).alias("end"), ids(c).alias("ids")))
    seq = tokens.sequence(own, F.size("captions") * 2000, F.lit(True), F.col("doc_id") % 3 == 0, sampling.drawn(F.col("doc_id")))
    docs = captioned(spark, sf_dir).select("doc_id", seq.alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_ids"), F.array_join("t", ",").alias("ids"), F.array_contains(tokens.sequence_faults(F.col("t")), "too long").alias("too_long"))


@query("SELECT page_id, CASE string_split(url, '/')[-3] WHEN 'ow_ckpts' THEN 'open' WHEN 'yodas' THEN 'yodas' WHEN 'owsm' THEN 'owsm' ELSE 'other' END AS kind, CASE WHEN contains(url, 'tiny') THEN 'tiny' WHEN contains(url, 'small') THEN 'small' WHEN contains(url, 'base') THEN 'base' WHEN contains(url, 'medium') THEN 'medium' WHEN contains(url, 'large') THEN 'large' ELSE 'unknown' END AS size FROM pages")
def q_model_info(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", T.model_kind(F.col("url")).alias("kind"), T.model_size(F.col("url")).alias("size"))


TIMES = """SELECT user_id, event_id, event_type || ' ' || user_id AS text, row_number() OVER w - 1 AS i, CAST(floor(value * {0}) AS BIGINT) AS d,
  CAST(sum(CAST(floor(value * {0}) AS BIGINT) + CASE WHEN event_id % 9 = 0 THEN 40000 ELSE 500 END) OVER w AS BIGINT) AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
EVENT_CAPTIONS = f"""docs AS (SELECT DISTINCT user_id AS doc_id FROM events), c AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY min(i)) AS i, z - d AS s, z AS e, arg_max(text, i) AS text FROM ({TIMES.format(300)}) GROUP BY user_id, z - d, z)"""
MS = "printf('%02d:%02d:%02d{1}%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"
CHECKED = f"""WITH RECURSIVE {EVENT_CAPTIONS},
{SEGMENTING},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) AS k, count(*) OVER (PARTITION BY doc_id) AS k_all FROM w),
g AS (SELECT n.doc_id, n.k, n.s, n.e, n.c1 IS NULL AS silent, n.k = n.k_all AS last, count(c.i) AS lines, CAST(coalesce(sum({W.format("c.text")}), 0) AS BIGINT) AS words, min(c.s) AS c_s, max(c.e) AS c_e, coalesce(bool_or(c.s > c.e), false) AS odd,
  'WEBVTT' || chr(10) || chr(10) || coalesce(string_agg({MS.format("greatest(0, c.s - n.s)", ".")} || ' --> ' || {MS.format("greatest(0, c.e - n.s)", ".")} || chr(10) || c.text || chr(10) || chr(10), '' ORDER BY c.i), '') AS content
  FROM n LEFT JOIN c ON c.doc_id = n.doc_id AND c.i BETWEEN n.c1 AND n.c2 GROUP BY ALL),
h AS (SELECT *, words + 2 * lines + (NOT last)::INT + 2 AS timed, words + 3 AS plain FROM g),
f AS (SELECT *, CASE WHEN NOT silent AND (odd OR c_e > e) THEN 'bad_text' WHEN NOT silent AND timed > 448 AND plain > 448 THEN 'over_ctx_len' WHEN e - s < 15 THEN 'faulty_audio' ELSE '' END AS fault FROM h)"""


def event_captions(spark, sf_dir):
    """Captions of a user: events in order, gaps and lengths from their values."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 300).alias("d"), F.when(F.col("event_id") % 9 == 0, 40000).otherwise(500).alias("gap"), F.concat_ws(" ", "event_type", "user_id").alias("text"))
    return placed(rows, "user_id", "event_id")


@query(f"""{CHECKED} SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS seg_no, s AS start_ms, e - s AS length_ms, silent, timed <= 448 AS ts_mode, plain <= 448 AS no_ts_mode,
  CASE WHEN silent THEN 0 ELSE timed END AS num_tokens_ts_mode, content AS seg_content, {MS.format("s", ",")} || '_' || CASE WHEN last OR silent THEN {MS.format("e", ",")} ELSE {MS.format("(s + 30000)", ",")} END AS audio_timestamp FROM f WHERE fault = ''""")
def q_segment_table(spark, sf_dir):
    """Segments that pass the checks of order, context and length, as subtitles."""
    found = segments.segment_table(event_captions(spark, sf_dir))
    return found.where("seg_no is not null").select("id", "seg_no", "start_ms", "length_ms", "silent", "ts_mode", "no_ts_mode", "num_tokens_ts_mode", "seg_content", "audio_timestamp")


@query(f"""{CHECKED} SELECT count(*) FILTER (fault = '') AS segment_count, (SELECT CAST(sum(long) AS BIGINT) FROM r) AS over_30_line_segment_count, count(*) FILTER (fault = 'bad_text') AS bad_text_segment_count,
  count(*) FILTER (fault = 'over_ctx_len') AS over_ctx_len_segment_count, count(*) FILTER (fault = 'faulty_audio') AS faulty_audio_segment_count, CAST(0 AS BIGINT) AS failed_transcript_count,
  count(DISTINCT CASE WHEN fault = '' THEN doc_id END) AS video_id_count, count(DISTINCT CASE WHEN fault = '' THEN doc_id END) * 30 / 3600 AS dur_by_video_id_count FROM f""")
def q_segment_counters(spark, sf_dir):
    return segments.counters(segments.segment_table(event_captions(spark, sf_dir)))


@query(f"""{CHECKED} SELECT CAST(doc_id AS VARCHAR) AS id, 'segment' AS stage, fault AS reason, count(*) AS n FROM f WHERE fault <> '' GROUP BY ALL
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'segment', 'over_30_line', CAST(sum(long) AS BIGINT) FROM r GROUP BY doc_id HAVING sum(long) > 0""")
def q_dead_letters(spark, sf_dir):
    return segments.dead_letters(segments.segment_table(event_captions(spark, sf_dir)))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type || ' ' || user_id AS text, CAST(floor(value * 300) AS BIGINT) AS d, CASE WHEN event_id % 9 = 0 THEN 40000 ELSE 500 END AS gap,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
p AS (SELECT *, sum(d + gap) OVER (PARTITION BY user_id ORDER BY i) AS z FROM e), u AS (SELECT user_id, i, text, CAST((z - d) // 10 AS BIGINT) AS a, CAST(z // 10 AS BIGINT) AS b FROM p),
-- utterance after utterance: the start of the segment, and its number
r AS (SELECT user_id, i, a AS first, 0 AS pack FROM u WHERE i = 0 UNION ALL
  SELECT u.user_id, u.i, CASE WHEN u.b - r.first <= 3000 THEN r.first ELSE u.a END, CASE WHEN u.b - r.first <= 3000 THEN r.pack ELSE r.pack + 1 END FROM r JOIN u ON u.user_id = r.user_id AND u.i = r.i + 1),
g AS (SELECT user_id, pack, min(a) AS a, max(b) AS b, count(*) AS n, CAST(sum({W.format("text")}) AS BIGINT) AS t, pack = max(pack) OVER (PARTITION BY user_id) AS last FROM r JOIN u USING (user_id, i) GROUP BY user_id, pack),
k AS (SELECT *, t + 2 * n + CASE WHEN last THEN 0 ELSE 1 END + 2 <= 448 AS ts_mode, t + 3 <= 448 AS no_ts_mode FROM g)
SELECT 'u' || user_id || printf('-%05d-%08d-%08d', pack, a, b) AS utt_id, n, round((b - a) / 100, 6) AS dur, ts_mode, no_ts_mode FROM k WHERE ts_mode OR no_ts_mode""")
def q_pack_utterances(spark, sf_dir):
    rows = event_captions(spark, sf_dir).select("id", F.posexplode("captions").alias("i", "c"))
    stamp = lambda ms: F.lpad(F.expr(f"{ms} div 10").cast("string"), 8, "0")
    made = rows.select(F.concat(F.concat(F.lit("u"), "id"), F.lit("-"), F.lpad(F.col("i").cast("string"), 5, "0"), F.lit("-"), stamp("c.start"), F.lit("-"), stamp("c.end")).alias("utt_id"), F.col("c.text").alias("text"))
    return segments.pack_utterances(made).select("utt_id", F.size("text").cast("long").alias("n"), "dur", "ts_mode", "no_ts_mode")


def event_stream(spark, sf_dir):
    """The events table as a file source; a pattern, as it is one file or a folder."""
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def drained(spark, stream, tag, mode):
    path = scratch(spark, tag)
    sessions.drain(stream, f"{path}/out", f"{path}/checkpoint", mode)
    return spark.read.parquet(f"{path}/out")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_counts(spark, sf_dir):
    """Hourly counts of a stream in update mode; of a window's rows the last batch's counts."""
    stream = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = drained(spark, sessions.windowed_counts(stream, "ts", "event_type", late="400 days"), "stream-counts", "update")
    return counts.groupBy("start", "event_type").agg(F.max_by("n", "batch_no").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT user_id AS session, right(string_agg(event_type || ' ', '' ORDER BY event_id), 200) AS text, CAST(sum(length(event_type) + 1) AS BIGINT) AS n_seen FROM events GROUP BY user_id")
def q_stream_sessions(spark, sf_dir):
    """Session buffers of the last 200 characters at the stream's end."""
    stream = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(" ")).alias("chunk"))
    kept = drained(spark, sessions.buffered(stream, timeout_ms=None, buffer=200), "stream-sessions", "update")
    last = kept.groupBy("session").agg(F.max_by(F.struct("text", "n_seen"), "batch_no").alias("k"))
    return last.select(F.col("session").cast("long").alias("session"), "k.text", "k.n_seen")


@query("SELECT source || '.tar' AS archive, CAST(doc_id AS VARCHAR) AS key, lang, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS text_md5 FROM documents")
def q_tar_shards(spark, sf_dir):
    """Each document as two members of its source's archive, written in one commit and read again as samples."""
    docs = load(spark, sf_dir, "documents")
    member = lambda ending, c: docs.select("source", F.concat("doc_id", F.lit(ending)).alias("member"), F.coalesce(c, F.lit("")).alias("content"))
    path = scratch(spark, "tar-shards")
    both = member(".txt", "text").unionByName(member(".lang", "lang"))
    committed.write_archives(both, path, F.concat("source", F.lit(".tar")), F.col("member"), F.col("content"))
    samples = archives.tar_samples(spark, path)
    text = F.col("parts")["txt"]
    return samples.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "key", F.decode(F.col("parts")["lang"], "UTF-8").alias("lang"), F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("text_md5"))


@query("""SELECT source || '.jsonl.gz' AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_no, doc_id, md5(coalesce(text, '')) AS text_md5, count(*) OVER (PARTITION BY source) AS n_rows FROM documents""")
def q_shard_files(spark, sf_dir):
    """Records by source in files of their own names, read again line by line, with the rows that the manifest says."""
    docs = load(spark, sf_dir, "documents")
    path = scratch(spark, "shards")
    committed.write_shards(docs, path, F.concat("source", F.lit(".jsonl.gz")), ["doc_id"], ["doc_id", "text"])
    lines = archives.read_lines(spark, path, "*.jsonl.gz").select(F.element_at(F.split("file", "/"), -1).alias("name"), "line_no", F.from_json("line", "doc_id long, text string").alias("r"))
    told = committed.manifest(docs, path).select("name", F.col("rows").alias("n_rows"))
    return lines.join(told, "name").select("name", "line_no", "r.doc_id", F.md5(F.coalesce("r.text", F.lit(""))).alias("text_md5"), "n_rows")


@query("""SELECT conv_id || '/' || turn || '.srt' AS name, md5('1' || chr(10) || '00:00:00,000 --> 00:00:02,000' || chr(10) || coalesce(text, '') || chr(10) || chr(10)) AS content_md5 FROM conversations""")
def q_segment_files(spark, sf_dir):
    """Each turn as a subtitle file of its own, in a folder for each conversation, written in one commit and read again."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    caption = F.array(F.struct(F.lit(0).alias("start"), F.lit(2000).alias("end"), F.col("text")))
    path = scratch(spark, "segment-files")
    committed.write_files(turns, path, F.concat_ws("/", "conv_id", F.concat("turn", F.lit(".srt"))), transcripts.write_subtitles(caption, F.lit(0), "srt"))
    found = archives.read_files(committed.manifest(turns, path), path)
    return found.select("name", F.md5("content").alias("content_md5"))


BUCKET = "(ascii({0}) * 961 + ascii(substr({0}, 2, 1)) * 31 + ascii(substr({0}, 3, 1)))"


@query(rf"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) AS w FROM documents),
f AS (SELECT doc_id, lang, {BUCKET.format("w")} % 4096 AS b FROM w UNION ALL SELECT doc_id, lang, ({BUCKET.format("right(w, 3)")} * 7 + 1) % 4096 FROM w),
c AS (SELECT lang, b, count(*) AS n FROM f WHERE doc_id % 3 <> 1 AND lang IS NOT NULL GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
s AS (SELECT f.doc_id, t.lang, sum(round(1000 * ln((coalesce(c.n, 0) + 1) / (t.total + 4096)))) AS score FROM f CROSS JOIN t LEFT JOIN c ON c.lang = t.lang AND c.b = f.b GROUP BY ALL)
SELECT doc_id, doc_id % 3 = 1 AS held_out, coalesce((SELECT s.lang FROM s WHERE s.doc_id = d.doc_id ORDER BY score DESC, s.lang LIMIT 1), 'en') AS text_lang FROM documents d""")
def q_text_lang_learned(spark, sf_dir):
    """Languages by profiles learned from two thirds of the documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.col("doc_id") % 3 == 1
    profiles = language.learn(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), language.language_of(F.col("text"), profiles).alias("text_lang"))


def vocabulary_path() -> str:
    """The public English vocabulary that stands in for a model's own."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query()
def q_ctx_tokens(spark, sf_dir):
    """Context checks with the tokens of a public vocabulary; equal to that of its own library in the tests."""
    docs = captioned(spark, sf_dir).select("doc_id", bpe.token_counts(vocabulary_path())(tokens.spoken(F.col("captions"))).alias("counts"))
    return docs.select("doc_id", F.array_join("counts", ",").alias("counts"), tokens.context_of(F.col("counts"), F.col("doc_id") % 2 == 1).alias("k")).select("doc_id", "counts", "k.*")


@query()
def q_token_ids(spark, sf_dir):
    """Training sequences with the ids of a public vocabulary: captions two seconds apart, a draw fixed by the id."""
    rows = captioned(spark, sf_dir).select("doc_id", bpe.token_ids(vocabulary_path())(tokens.spoken(F.col("captions"))).alias("c"))
    own = F.transform("c", lambda ids, i: F.struct((i * 2000).alias("start"), (i * 2000 + 1500).alias("end"), ids.alias("ids")))
    seq = tokens.sequence(own, F.size("c") * 2000, F.lit(True), F.col("doc_id") % 3 == 0, sampling.drawn(F.col("doc_id")))
    return rows.select("doc_id", seq.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_ids"), F.array_join("t", ",").alias("ids"), F.array_contains(tokens.sequence_faults(F.col("t")), "too long").alias("too_long"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS d, CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS c FROM orders WHERE o_totalprice >= 1)
SELECT o_orderkey, regexp_replace('order ' || o_orderkey || ' paid $' || d || '.' || printf('%02d', c) || ' for the ' || o_custkey
  || CASE WHEN o_custkey % 100 IN (11, 12, 13) THEN 'th' WHEN o_custkey % 10 = 1 THEN 'st' WHEN o_custkey % 10 = 2 THEN 'nd' WHEN o_custkey % 10 = 3 THEN 'rd' ELSE 'th' END || ' time', '\\b1(s?)\\b', 'one\\1', 'g') AS normal FROM o""")
def q_spoken_numbers(spark, sf_dir):
    """Orders told in words, normalised to digits again: keys, sums of money, ordinals."""
    price, key = F.col("o_totalprice").cast("double"), F.col("o_custkey")
    dollars, cents = F.floor(price), F.round(price * 100).cast("long") % 100
    rows = load(spark, sf_dir, "orders").where(price >= 1).withColumn("customer", numbers.spelled(key))
    ordinal, last = F.regexp_replace("customer", r"(\w+)$", ""), F.regexp_extract("customer", r"(\w+)$", 1)
    names = F.create_map(*(F.lit(x) for w in (*numbers.SMALL, *numbers.TENS, "hundred", *numbers.SCALES) for x in (w, numbers.ordinal(w))), F.lit("zero"), F.lit("zeroth"))
    told = F.concat(F.lit("Order "), numbers.spelled(F.col("o_orderkey")), F.lit(" paid "), numbers.spelled(dollars), F.lit(" dollars and "), numbers.spelled(cents), F.lit(" cents, for the "), ordinal, names[last], F.lit(" time."))
    return rows.select("o_orderkey", T.normalise_english(told).alias("normal"))


@query("""WITH d AS (SELECT d.doc_id, coalesce(text, '') AS text, l.doc_id IS NOT NULL AS labelled, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT count(*) AS n, count(*) FILTER (text = '') AS e, sum(length(text)) AS s, count(*) FILTER (NOT labelled) AS m, count(*) FILTER (coalesce(toxic, 0) = 1) AS t, count(*) FILTER (coalesce(toxic, 0) = 0) AS k FROM d)
SELECT stage, counter, CAST(value AS DOUBLE) AS value FROM c, LATERAL (VALUES ('ingest', 'rows', n), ('ingest', 'empty', e), ('ingest', 'characters', s), ('language', 'rows', n), ('language', 'missing', m),
  ('filter', 'rows', k), ('files', 'kept.jsonl.gz', k), ('files', 'missing.jsonl.gz', m), ('files', 'toxic.jsonl.gz', t)) v(stage, counter, value) WHERE stage <> 'files' OR value > 0""")
def q_run_report(spark, sf_dir):
    """Counters of three stages and the files of a run, in parts by task, all from one pass: records, dead letters of missing and of toxic ones."""
    report, path = outputs.Report(), scratch(spark, "run")
    docs = report.watch(load(spark, sf_dir, "documents"), "ingest", empty=F.coalesce("text", F.lit("")) == "", characters=F.length("text"))
    known = docs.join(load(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(True).alias("labelled")), "doc_id", "left")
    missing, toxic = F.col("labelled").isNull(), F.coalesce("toxic", F.lit(0)) == 1
    watched = report.watch(known, "language", missing=missing)
    lines = outputs.routed(
        watched, (F.when(~toxic, "kept.jsonl.gz"), F.to_json(F.struct("doc_id", "text")), F.col("doc_id")),
        (F.when(missing, "missing.jsonl.gz"), outputs.letter("doc_id", "language", "missing"), F.col("doc_id")), (F.when(toxic, "toxic.jsonl.gz"), outputs.letter("doc_id", "filter", "toxic"), F.col("doc_id")))
    outputs.write_parts(path, report.watch(lines, "lines", kept=F.col("name") == "kept.jsonl.gz"), split=True)
    told = report.table(spark).where("stage <> 'lines' OR counter = 'kept'").select(F.when(F.col("stage") == "lines", "filter").otherwise(F.col("stage")).alias("stage"), F.when(F.col("stage") == "lines", "rows").otherwise(F.col("counter")).alias("counter"), "value")
    files = committed.manifest(docs, path).groupBy(outputs.file_of(F.col("name")).alias("counter")).agg(F.sum("rows").cast("double").alias("value"))
    return told.unionByName(files.select(F.lit("files").alias("stage"), "counter", "value"))


@query(f"""WITH RECURSIVE m AS (SELECT user_id, i // 3 AS n, min(z - d) AS s, max(z) AS e FROM ({TIMES.format(400)}) GROUP BY ALL),
c AS (SELECT user_id, list({{'s': z - d + 700, 'e': z + 700, 't': {W.format("text")}}} ORDER BY i) AS c FROM ({TIMES.format(400)}) GROUP BY user_id),
b AS (SELECT user_id, c, (SELECT list({{'s': s, 'e': e}} ORDER BY n) FROM m WHERE m.user_id = c.user_id AND n < 120) AS m FROM c),
-- one run after another: where it starts, where it ends, what becomes of it
r AS (SELECT user_id, c, m, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS VARCHAR) AS kind FROM b UNION ALL
  SELECT user_id, c, m, k + (kind = 'segment')::INT, b + 1, a, b, kind FROM (SELECT *, CASE WHEN c[a].e - c[a].s > 30000 THEN 'over_30_line'
      WHEN list_sum(list_transform(c[a:b], lambda x: x.t)) + 2 * (b - a + 1) + (b < len(c))::INT + 2 > 448 AND list_sum(list_transform(c[a:b], lambda x: x.t)) + 3 > 448 THEN 'over_ctx_len'
      WHEN c[b].e - c[a].s < 15 THEN 'faulty_audio' ELSE 'segment' END AS kind FROM (
    SELECT user_id, c, m, k, a, CASE WHEN c[a].e - c[a].s > 30000 THEN a ELSE coalesce(list_filter(range(a, len(c)), lambda j: c[j + 1].e - c[j + 1].s > 30000 OR abs(c[j + 1].e - m[k + 1].e) > abs(c[j].e - m[k + 1].e))[1], len(c)) END AS b FROM (
      SELECT user_id, c, m, k, coalesce(list_filter(range(pos, len(c)), lambda i: abs(c[i + 1].s - m[k + 1].s) >= abs(c[i].s - m[k + 1].s))[1], len(c)) AS a FROM r WHERE pos <= len(c) AND k < len(m)))))
SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN kind = 'segment' THEN CAST(k - 1 AS INTEGER) ELSE -1 END AS seg_no, kind, c[a].s AS start, c[b].e AS "end", b - a + 1 AS n FROM r WHERE kind IS NOT NULL""")
def q_machine_segments(spark, sf_dir):
    """Machine captions 700 ms late, some too long for a window, cut to a user's segments of three captions each."""
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 400).alias("d"), F.when(F.col("event_id") % 9 == 0, 40000).otherwise(500).alias("gap"), F.concat_ws(" ", "event_type", "user_id").alias("text"))
    own = Window.partitionBy("user_id").orderBy("event_id")
    end = F.sum(F.col("d") + F.col("gap")).over(own)
    timed_rows = rows.select(F.col("user_id").cast("string").alias("id"), (F.row_number().over(own) - 1).alias("n"), (end - F.col("d")).alias("start"), end.alias("end"), "text")
    manual = timed_rows.groupBy("id", F.floor(F.col("n") / 3).alias("n")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    late = timed_rows.withColumns({"start": F.col("start") + 700, "end": F.col("end") + 700})
    made = machine.machine_segments(manual, late)
    return made.select("id", F.coalesce("seg_no", F.lit(-1)).alias("seg_no"), "kind", "start", "end", F.size("texts").cast("long").alias("n"))


@query("""SELECT user_id AS session, string_agg(event_type || ' ', '' ORDER BY event_id) AS text, CAST(sum(length(event_type) + 1) AS BIGINT) AS n_chars FROM events GROUP BY user_id""")
def q_session_texts(spark, sf_dir):
    """Whole session texts from the list state that a stream leaves behind; batches only add to it."""
    stream = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(" ")).alias("chunk"))
    path = scratch(spark, "session-texts")
    sessions.drain(sessions.appended(stream, None, emit_text=False), f"{path}/out", f"{path}/checkpoint", "update", sessions.ROCKSDB)
    return sessions.session_texts(spark, f"{path}/checkpoint").select(F.col("session").cast("long").alias("session"), "text", "n_chars")


@query(f"""WITH RECURSIVE m AS (SELECT user_id, i // 3 AS n, min(z - d) AS s, max(z) AS e FROM ({TIMES.format(300)}) GROUP BY ALL),
c AS (SELECT user_id, list({{'s': z - d + 700, 'e': z + 700, 't': text}} ORDER BY i) AS c FROM ({TIMES.format(300)}) GROUP BY user_id),
b AS (SELECT user_id, c, (SELECT list({{'s': s, 'e': e}} ORDER BY n) FROM m WHERE m.user_id = c.user_id) AS m FROM c),
r AS (SELECT user_id, c, m, CAST(-1 AS BIGINT) AS k, CAST(1 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM b UNION ALL
  SELECT user_id, c, m, k, b + 1, a, b FROM (SELECT user_id, c, m, k, a, coalesce(list_filter(range(a, len(c)), lambda j: abs(c[j + 1].e - m[k + 1].e) > abs(c[j].e - m[k + 1].e))[1], len(c)) AS b FROM (
    SELECT user_id, c, m, k + 1 AS k, coalesce(list_filter(range(pos, len(c)), lambda i: abs(c[i + 1].s - m[k + 2].s) >= abs(c[i].s - m[k + 2].s))[1], len(c)) AS a FROM r WHERE pos <= len(c) AND k + 1 < len(m))))
SELECT CAST(user_id AS VARCHAR) AS id, k AS seg_no, m[k + 1].s AS start, m[k + 1].e AS "end", a - 1 AS first, b - 1 AS last, array_to_string(list_transform(c[a:b], lambda x: x.t), ' ') AS text FROM r WHERE k >= 0""")
def q_nearest_align(spark, sf_dir):
    """A user's windows of three captions each against captions 700 ms late."""
    docs = event_captions(spark, sf_dir)
    spans = F.transform(F.sequence(F.lit(1), F.size("captions"), F.lit(3)), lambda k: F.struct(F.get("captions", k - 1)["start"].alias("start"), F.get("captions", F.least(k + 1, F.size("captions") - 1))["end"].alias("end")))
    late = F.transform("captions", lambda c: F.struct((c.start + 700).alias("start"), (c.end + 700).alias("end"), c.text.alias("text")))
    found = align.nearest_align(docs.select("id", spans.alias("segments"), late.alias("captions")))
    return found.select("id", "seg_no", "start", "end", "first", "last", F.array_join("texts", " ").alias("text"))


def in_two_runs(spark, sf_dir, state, tag):
    """States of the events' shards (user_id % 7): even ones first, then odd ones and one again."""
    rows, path = load(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 7), scratch(spark, tag)
    for some in ("shard % 2 = 0", "shard % 2 = 1 OR shard = 4"):
        mergeable.keep(state(rows.where(some)), path, "shard")
    return mergeable.kept(spark, path)


@query(ORACLES["q_reservoir"])
def q_reservoir_merged(spark, sf_dir):
    """The overall sample from states of shards, kept in two runs."""
    state = in_two_runs(spark, sf_dir, lambda rows: mergeable.sample_state(rows.select("event_id", "value", "shard"), "shard", "event_id", 1000), "samples")
    return mergeable.merged_sample(state, "event_id", 1000).select("event_id", "value")


@query(ORACLES["q_percentiles"])
def q_percentiles_merged(spark, sf_dir):
    """Exact percentiles from the counted values of shards, kept in two runs."""
    state = in_two_runs(spark, sf_dir, lambda rows: mergeable.value_state(rows, "shard", "value"), "values")
    return mergeable.merged_percentiles(state, int(spark.conf.get("spark.sql.shuffle.partitions")))
