"""Registered queries on the smallest tables against brute force, and operators on awkward tables."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from sparrowmill.llm import language, near_dup, packing, pii, registry, suffix_dedup, topk_search
from sparrowmill.llm.tokens import encoder
from test_llm import brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_op2(spark, texts):
    for g in result(spark, "op2_media_columns"):
        raw = texts[g["doc_id"]].encode()
        whole = raw + bytes(-len(raw) % 64 or (not raw) * 64)
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))


def test_op3(spark, texts):
    want = brute_repeats(list(texts.items()), 100)
    assert all(tuple(g)[1:5] == want[g["doc_id"]] for g in result(spark, "op3_suffix_dedup"))


def test_op4(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    low = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and low[a] != low[b]:
                x, y = sorted((low[a], low[b]))
                low = {i: x if c == y else c for i, c in low.items()}
    assert {(g["doc_id"], g["n_shingles"], g["component_id"], g["kept"]) for g in result(spark, "op4_near_dup")} == {(i, len(s), low[i], low[i] == i) for i, s in sets.items()}


def test_op7_op8(spark, texts):
    one, two = encoder("byte_bpe_50k.json").tok, encoder("word_bpe_49k.json").tok
    ids = {i: [*one.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    at = 0
    got = {g["doc_id"]: g for g in result(spark, "op7_token_files")}
    for i in sorted(ids):
        raw = struct.pack(f"<{len(ids[i])}I", *ids[i])
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids[i]), zlib.crc32(raw))
        at += len(ids[i])
    want = set()
    for i, t in texts.items():
        own = [*two.encode(t, add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(own), 2048)):
            part = own[a : a + 2048]
            want.add((i, k, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    packed = result(spark, "op8_best_fit_packing")
    assert {tuple(g)[:5] for g in packed} == want and len(packed) == len(want)
    places = {}
    for g in packed:
        places.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(places) <= packing.lower_bound([g["length"] for g in packed], 2048) + 1


def test_op10(spark, texts):
    got = result(spark, "op10_language")
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1) for g in got) and {g["doc_id"] for g in got} == set(texts)


def test_frequent_fingerprints(spark, monkeypatch):
    """Every repeated fingerprint taken as frequent: its windows are dealt one by one."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    r = random.Random(8)
    word = lambda n: "".join(r.choices("abcdefghij ", k=n))
    passage, edge = word(400), word(130)
    docs = [(i, word(r.randint(0, 300)) + (passage if i % 3 else edge) + word(r.randint(0, 300))) for i in range(40)] + [(50, "z" * 700), (51, "z" * 650 + word(50)), (52, passage)]
    want = brute_repeats(docs, 100)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs) and all(tuple(g)[1:5] == want[g["doc_id"]] for g in got)


def test_pieces_of_long_texts(monkeypatch):
    r = np.random.default_rng(3)
    raw = r.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.anchors(raw, 100)[0].tolist()
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    found = []
    for a, b, place, part in suffix_dedup.pieces(raw, 100):
        if len(part) >= 100:
            found += [p + place for p in suffix_dedup.anchors(part, 100)[0].tolist() if a <= p + place < b]
    assert found == whole


def test_clashing_names_and_repeated_rows(spark):
    names = "doc_id long, text string, key string, _key string, owner string, text_key string, kept_bytes string, near_id string, score string, lang_pred string, id string, component string"
    row = ("the same text " * 20, *["x"] * 10)
    docs = spark.createDataFrame([(1, *row), (1, *row), (2, *row), (None, *row), (3, None, *["x"] * 10)], names)
    removed = suffix_dedup.remove_repeats(docs)
    assert removed.columns == docs.columns and removed.count() == 5
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (True, 0)]
    assert pii.mask_pii(docs).columns == docs.columns and pii.mask_pii(docs.limit(0)).count() == 0
    assert language.predict(docs, {"names": []}, ("p", "q", "r")).where("p = 'und'").count() == 5
    assert packing.best_fit_packing(docs, "word_bpe_49k.json", 0, 64).select("doc_id").where("doc_id = 1").count() >= 2
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0 and near_dup.keep_one(docs.limit(0)).count() == 0
    two = spark.createDataFrame([("a", 1), ("b", 2)], "text string, doc_id long")
    other = spark.createDataFrame([(7, "a"), (7, "b c d e f g")], "doc_id long, text string")
    assert near_dup.keep_one(other).count() == 2 and near_dup.keep_one(two).count() == 2


def test_topk_ties_and_repeats(spark):
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(30, [2.0, 0.0]), (30, [2.0, 0.0]), (40, [1.0])]
    v = topk_search.usable(spark.createDataFrame(rows, "id long, v array<double>"))
    got = topk_search.top_k(v.where("id = 0"), v, 4).orderBy("rank").collect()
    assert [(g["vec_id"], g["score"]) for g in got] == [(30, 131072), (30, 131072), (1, 65536), (2, 65536)]


def test_added_spans_are_found():
    """Planted secrets and written-out addresses among prose: what share of them is found, and nothing else."""
    r = random.Random(12)
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    prose = lambda: " ".join("".join(r.choices("aeioustrnl", k=r.randint(2, 8))) for _ in range(40))
    docs = []
    for i in range(400):
        planted = [f'token = "{hexes(40)}"', f"password: {hexes(12)}", f"api_key={hexes(32)}", "write to jo.doe at mail dot example dot com", None, None, "see page 1234567 or isbn 97800000", "dots at the dot end"][i % 8]
        docs.append((prose() + " " + (planted or "") + " " + prose(), i % 8))
    counts = {}
    for t, _ in docs:
        base = pii.base_spans(t)
        for s in base + pii.candidates(t, base):
            v = pii.votes(t, *s)
            counts[v] = counts.get(v, 0) + 1
    model = pii.fit(counts)
    found = {k: sum(bool(pii.all_spans(t, model)[1]) for t, j in docs if j == k) / 50 for k in range(8)}
    assert min(found[k] for k in range(4)) >= 0.9 and max(found[k] for k in range(4, 8)) == 0


def test_op4_rows_without_id(spark, tmp_path):
    texts = ["A b c d e", "a B c d e f f f f f", "one two", " ", "", None, "x x x x x x", "É a b c d", "a\x0bb\tc  d"]
    spark.createDataFrame([(None, t) for t in texts] + [(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op4_near_dup"](spark, str(tmp_path)).collect()
    assert len(got) == 2 * len(texts)
    named, alone = [sorted(g["n_shingles"] for g in got if (g["doc_id"] is None) == none) for none in (False, True)]
    assert named == alone and all(g["component_id"] is None and g["kept"] for g in got if g["doc_id"] is None)
