"""Learned languages and a public vocabulary's tokens."""

import random

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import bpe, tokens
from sparrowmill.operators import language, segments, tags
from sparrowmill.plans import registry

SF = "/root/testdata/sf0.001"


def test_learned_languages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = registry.QUERIES["q_text_lang_learned"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = {r["lang"]: r["p"] for r in got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("text_lang")).cast("int")).alias("p")).collect()}
    assert len(right) == 4 and min(right.values()) > 0.95
    rows = spark.createDataFrame([("the cat", "en"), ("der hund", "de"), (None, "de"), ("x", None)], "text string, lang string")
    profiles = language.learn(rows, buckets=64)
    assert sorted(profiles) == ["de", "en"] and all(len(w) == 64 for w in profiles.values())
    odd = spark.createDataFrame([("THE", "en"), ("der", "de"), ("", "en"), (None, "en"), ("12 !", "en"), ("der " * 50_000, "de")], "text string, want string")
    judge = language.language_of(F.col("text"), profiles).alias("got")
    assert all(r["got"] == r["want"] for r in odd.select("want", judge).collect())
    assert language.learn(rows.limit(0)) == {} and odd.limit(1).select(language.language_of(F.col("text"), {}).alias("l")).first()["l"] == "en"
    language.as_table(spark, profiles).write.parquet(f"{tmp_path}/p")
    assert language.from_table(spark.read.parquet(f"{tmp_path}/p")) == profiles
    tagged = tags.tag(odd.where("want = 'de'").select(F.array("text").alias("captions")), ["text_lang"], profiles=profiles)
    assert {r["text_lang"] for r in tagged.collect()} == {"de"}


@pytest.fixture(scope="module")
def library():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(library):
    v = bpe.Vocabulary(registry.vocabulary_path())
    r = random.Random(2)
    made = ["".join(r.choices("the ingéßá日本 \n\t'sll0 1.,!?_-🙂 ", k=r.randint(0, 60))) for _ in range(3000)]
    for t in ["", " ", "  x", "x  ", "'s 'll I'm", "\r\n \r\n", "a" * 50_000, "ab" * 20_000, "é" * 3000, "<|endoftext|>", *made]:
        assert v.encode(t) == library.encode_ordinary(t)


def test_token_queries(spark, library):
    docs = {r["doc_id"]: (r["text"] or "").split("\n") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.QUERIES["q_ctx_tokens"](spark, SF).collect():
        want = [len(library.encode_ordinary(" " + c.strip(" "))) for c in docs[r["doc_id"]]]
        timed, plain = sum(want) + 2 * len(want) + (r["doc_id"] % 2 == 0) + 2, sum(want) + 3
        assert r["counts"] == ",".join(map(str, want)) and (r["num_tokens_ts_mode"], r["num_tokens_no_ts_mode"], r["over"]) == (timed, plain, timed > 448 and plain > 448)
    for r in registry.QUERIES["q_token_ids"](spark, SF).where("ids like '50257,50362%'").collect():
        own = [library.encode_ordinary(" " + c.strip(" ")) for c in docs[r["doc_id"]]]
        kept = own[:-1] if len(own) * 2000 > 30_000 and len(own) > 1 else own
        assert r["ids"] == ",".join(map(str, [50257, 50362, *(i for c in kept for i in c), 50256]))


def test_segments_by_tokens(spark, library):
    text = "antidisestablishmentarianism " * 30
    docs = spark.createDataFrame([("a", [(0, 9000, text)] * 1)], "id string, captions array<struct<start:long,end:long,text:string>>")
    got = segments.segment_table(docs, bpe.Counter(registry.vocabulary_path())).first()
    assert got["num_tokens_no_ts_mode"] == len(library.encode_ordinary(text.strip())) + 3
    null = spark.createDataFrame([(None,), ([None, ""],)], "c array<string>")
    counted = null.select(bpe.token_counts(registry.vocabulary_path())("c").alias("n")).collect()
    assert [r["n"] for r in counted] == [None, [0, 0]]
    assert null.select(tokens.context_of(F.lit(None).cast("array<int>"), F.lit(True))["over"].alias("o")).first()["o"]
