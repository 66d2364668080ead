"""Registered queries against libraries, what each pipeline stage does to planted documents, and a text of ten million characters."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import divergence, language, media, mixing, near_dup, pii, registry, repair, suffix_dedup

SF = "/root/testdata/sf0.001"


def test_op1_equals_the_library(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["op1_sentencepiece"](spark, SF).collect()
    assert {g["doc_id"] for g in got} == set(texts)
    for g in got:
        ids = sp.encode(texts[g["doc_id"]])
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (g["n_tokens"], g["ids_crc32"], g["decoded_sha256"]) == (len(ids), zlib.crc32(raw), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_op10_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()}
    right = []
    for g in registry.QUERIES["op10_language"](spark, sf).collect():
        text, lang = docs[g["doc_id"]]
        assert 0 <= g["score"] <= 1 and g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1)
        if text is None or not re.search(r"[^\W\d_]", text):
            assert g["lang_pred"] == "und"
        elif g["held_out"]:
            right.append(g["lang_pred"] == lang)
    assert len(right) > 250 and sum(right) / len(right) > 0.97


def test_what_the_stages_do(spark):
    import corpus_pipeline as p

    r = random.Random(11)
    syllables = {"en": ["the", "ing", "th", "of", "er", "and"], "de": ["der", "ung", "sch", "ein", "und", "ö"]}
    prose = lambda lang, n: " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 4))) for _ in range(n))
    rows = [(i, prose(lang := r.choice(["en", "de"]), 120), lang, "s", 0) for i in range(300)]
    near = prose("en", 200)
    passage = prose("de", 60)
    rows += [(400, near, "en", "s", 0), (401, near.replace(" ", "  ", 1) + " end", "en", "s", 0), (402, near, "en", "s", 0)]
    rows += [(500, prose("de", 90) + " " + passage, "de", "s", 0), (501, passage + " " + prose("de", 90), "de", "s", 0)]
    rows += [(600, prose("en", 50) + " write to jo.doe@mail.example.com or +1 415 555 0123 " + prose("en", 50), "en", "s", 0), (700, "12 34 !", "en", "s", 0), (701, "", "en", "s", 0), (702, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = {i: t for i, t, *_ in rows}
    out = {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = [(g["doc_id"], g["text"]) for g in docs.collect()]
        docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in kept], "doc_id long, text string, lang string, source string, n_chars long")
        out[name] = dict(kept)
    clean = set(range(300))
    assert clean | {400, 401, 402, 500, 501, 600} == set(out["language ID"])
    assert set(out["language ID"]) - set(out["MinHash near-dedup"]) == {401, 402}
    cut = out["suffix-array dedup"]
    assert cut[500] == texts[500] and passage not in cut[501] and cut[501].strip() in texts[501] and len(texts[501]) - len(cut[501]) >= len(passage)
    assert sum(cut[i] == texts[i] for i in clean) > 290
    masked = out["PII"][600]
    assert "<EMAIL>" in masked and "<PHONE>" in masked and "@" not in masked and "555" not in masked
    packed = p.STAGES[-1][1](spark, docs, "")
    assert {g["doc_id"] for g in packed.collect()} == set(out["PII"])
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert p.language_id(spark, unlabelled, "").count() == docs.count()


@pytest.fixture(scope="module")
def long(spark):
    """A text of ten million characters beside small ones, null and empty."""
    r = random.Random(1)
    text = " ".join("".join(r.choices("abcdefghié", k=r.randint(2, 9))) for _ in range(1_500_000))
    return text, spark.createDataFrame([(1, text, "xx", "s"), (2, "short one", "xx", "s"), (3, None, "xx", None), (4, "", "xx", "s")], "doc_id long, text string, lang string, source string")


def test_long_text(spark, long):
    text, docs = long
    words = len(text.split(" "))
    sizes = {g["doc_id"]: g["size"] for g in mixing.mix(docs).collect()}
    assert sizes == {1: words, 2: 2, 3: 0, 4: 0}
    counts = divergence.term_counts(docs).agg(F.sum("n"), F.sum("in_docs")).first()
    assert tuple(counts) == (words + 2, len(set(text.split(" "))) + 2)
    raw = text.encode()
    stored = {g["doc_id"]: g for g in media.media_features(media.media_column(docs)).collect()}
    assert stored[1]["payload_bytes"] == len(raw) + (-len(raw) % 64 or 0)
    cut = {g["doc_id"]: g for g in suffix_dedup.suffix_dedup(docs).collect()}
    assert (cut[1]["n_bytes"], cut[1]["n_removed"]) == (len(raw), 0)
    found = {g["id"]: g["n_shingles"] for g in near_dup.near_duplicates(docs.select(F.col("doc_id").alias("id"), "text"), words=4).collect()}
    own = text.split(" ")
    assert found[1] == len({tuple(own[i : i + 4]) for i in range(words - 3)}) and found[2] == 1
    assert {g["doc_id"]: len(g["spans"]) for g in pii.find_pii(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    model = language.train(spark.createDataFrame([(1, "aa bb", "a"), (2, "éé cc", "b")], "doc_id long, text string, lang string"))
    assert {g["lang_pred"] for g in language.predict(docs, model).where("doc_id = 1").collect()} <= {"a", "b"}
    turns = spark.createDataFrame([(1, 0, "user", text + "."), (1, 1, "assistant", "ok.")], "conv_id long, turn long, role string, text string")
    report, fixed = repair.repair(turns)
    assert report.first()["audit"] == "KK" and repair.digests(fixed).first()["repaired_sha256"] == hashlib.sha256(f"user:{text}.\nassistant:ok.".encode()).hexdigest()


def test_kept_rows_are_defined(spark):
    rows = [(1, "a b c d e f g", "z", 2), (1, "a b c d e f g", "b", 9), (1, "a b c d e f g", None, 1), (2, "x", "q", 1)]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long").repartition(parts)
        assert sorted(map(tuple, near_dup.keep_one(docs).collect()), key=str) == [(1, "a b c d e f g", "b", 9), (2, "x", "q", 1)]
