"""Mixing, conversation repair and source divergence against brute force and SQL; personal data of the registered query."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import divergence, mixing, pii, registry, repair

SF = "/root/testdata/sf0.001"


def rounded(rows, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", ["op5_chat_format", "op9_topk_search", "op11_mixing", "op12_repair", "op13_divergence"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    told = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(told.columns)
    assert rounded(got.collect(), got.columns) == rounded([dict(zip(told.columns, r)) for r in told.fetchall()], got.columns)


def targets(sizes, weights=(5, 2, 1), most=3):
    """Exact: reshare until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, full, total = {s: weights[i % len(weights)] for i, s in enumerate(order)}, set(), sum(sizes.values())
    while True:
        rest, share = total - sum(most * sizes[s] for s in full), sum(w[s] for s in order if s not in full)
        now = {s for s in order if s not in full and Fraction(w[s] * rest, share or 1) > most * sizes[s]}
        if not now:
            return {s: float(most * sizes[s] if s in full else Fraction(w[s] * rest, share or 1)) for s in order}
        full |= now


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 7, 300])), r.choice(["a", "b", "é", "𝄞", "", None]), "x") for i in range(400)] + [(900, None, "none", "x"), (901, "", "none", "x"), (None, "p q", "b", "x"), (3, "same", "a", "x"), (3, "same", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "target", "size", "source_size", "_target", "copies"]
    got = got.collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    assert len(got) == len(rows) and {g["source"]: g["_target"] for g in got} == want
    taken = Counter()
    for g in got:
        rate = want[g["source"]] / sizes[g["source"]] if sizes[g["source"]] else 0
        assert g["source_size"] == sizes[g["source"]] and g["copies"] in (int(rate), int(rate) + (rate % 1 > 0)) and g["copies"] <= 3
        taken[g["source"]] += g["size"] * g["copies"]
    assert all(abs(taken[s] - want[s]) <= 300 for s in want)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    same = mixing.mix(docs.repartition(5).withColumn("n", F.lit(1)), size=F.col("n"))
    assert mixing.emit(same).count() == same.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.where("text is null")).first()["_target"] == 0


def test_mixing_many_sources(spark, monkeypatch):
    """Rates joined by shuffle instead of broadcast give the same mix; sources are ranked across parts."""
    docs = spark.createDataFrame([(i, f"s{i % 37}", 1 + i % 50) for i in range(1000)], "doc_id long, source string, n long").repartition(7)
    one = sorted(map(str, mixing.mix(docs, size=F.col("n")).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs, size=F.col("n")).collect())) == one
    order = mixing.ranked(docs.select("source").distinct().repartition(5), "source").collect()
    assert [r["source"] for r in sorted(order, key=lambda r: r["nth"])] == sorted(f"s{i}" for i in range(37)) and sorted(r["nth"] for r in order) == list(range(37))


def brute_repair(turns):
    """(row of the contract) for [(turn, role, text)] in order: cheapest first, then least audit, over all edits."""
    seen, faults = set(), []
    for _, role, text in turns:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(turns) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        for c, name in (("u", "user"), ("a", "assistant")):
            if (last, c) in follow:
                heapq.heappush(heap, (cost + 3, audit + "I", i, c, (*lines, name + ":")))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                if (last, role[:1]) in follow:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (last, c) in follow:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, c, (*lines, f"{name}:{text}")))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), "\n".join(lines)


def random_turns(r, n):
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " ", None])
    text = lambda: r.choice(["Ja.", "no", "a b!", "  ", "", None, "why? \n", "é", "x" * 50 + "."])
    return [(r.choice([None, i, i, i, i // 2, 3 * i]), role(), text()) for i in range(n)]


@pytest.mark.parametrize("block", [3, 4096])
def test_repair(spark, monkeypatch, block):
    """Also in blocks of three turns, so that conversations have many; more turns of one conversation than of all others."""
    monkeypatch.setattr(repair, "BLOCK", block)
    r = random.Random(block)
    rows = [(c, *t, "x") for c in range(60) for t in random_turns(r, r.randint(1, 9))] + [(None, *t, "x") for t in random_turns(r, 400)] + [(61, None, None, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string").repartition(6)
    report, fixed = repair.repair(turns)
    got = {g["key"]: tuple(g)[1:] for g in report.collect()}
    lines = defaultdict(list)
    for g in fixed.collect():
        lines[g["key"]].append(f"{g['role']}:{g['text']}")
    for c in {row[0] for row in rows}:
        own = [(t, " " if role is None else role, " " if text is None else text) for k, t, role, text, _ in rows if k == c]
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        key = " " if c is None else str(c)
        want, told = brute_repair(own)
        assert got[key] == want and "\n".join(lines[key]) == told
    assert len(got) == 62 and repair.repair(turns.limit(0))[0].count() == 0
    sums = {g["key"]: g["repaired_sha256"] for g in repair.digests(fixed).collect()}
    assert sums == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in lines.items() if v}


def test_damage(spark):
    rows = [(c, t, "assistant", f"Hi {c}. Yes! no?") for c in range(40) for t in range(5)]
    got = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    kinds = {(c, t): zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, _, _ in rows}
    want = Counter()
    for c, t, role, text in rows:
        k = kinds[c, t]
        if k:
            want[(c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] += 1 + (k == 3)
    assert Counter((g["conv_id"], g["turn"], g["role"], g["text"]) for g in got) == want


def brute_audit(docs, least, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for text, lang, source in docs]
    seen, counts = Counter(), defaultdict(Counter)
    for lang, source, terms in found:
        seen.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = set()
    for (lang, source), own in counts.items():
        kept = sorted(t for (v, t), n in seen.items() if v == lang and n >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        p, whole = share(own), share(sum((c for (v, _), c in counts.items() if v == lang), Counter()))
        pairs = [(-sum(far(p[t], q[t]) for t in kept), s) for (v, s), c in counts.items() if v == lang and s != source for q in [share(c)]]
        terms = [(-far(p[t], whole[t]), t) for t in kept if own[t] and p[t] > whole[t]]
        by = lambda x: (x[0], x[1].encode())
        out |= {(lang, source, "pair", s, -v, i + 1) for i, (v, s) in enumerate(sorted(pairs, key=by))}
        out |= {(lang, source, "term", t, -v, i + 1) for i, (v, t) in enumerate(sorted(terms, key=by)[:top])}
    return out


@pytest.mark.parametrize("limit", [0, 100_000])
def test_audit(spark, monkeypatch, limit):
    """With groups broadcast, and joined in salted parts."""
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", limit)
    r = random.Random(6)
    words = ["Der", "der", "éa", "𝄞x", "it's", "x1y", "A_B", "ßo", "İz", "z", "q", "日本"]
    docs = [(" ".join(r.choices(words, k=r.choice([0, 3, 30]))), r.choice(["de", "en", None]), r.choice(["s1", "s2", "s10", None])) for _ in range(120)]
    docs += [(None, "de", "s1"), ("", "xx", "s1"), ("1 2", "xx", "s3"), docs[0], docs[0], ("é" * 50000, "en", "s1")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "text string, lang string, source string, term string")
    got = divergence.audit(df, 10, 4)
    assert {tuple(g) for g in got.collect()} == brute_audit(docs, 10, 4)
    assert divergence.audit(df.limit(0)).count() == 0


def test_large_counts(spark):
    """Counts beyond what whole numbers of 64 bits hold when scaled."""
    row = spark.sql("SELECT 10000000000000L AS n, 30000000000007L AS total, 5L AS v")
    assert row.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (10**13 + 2) // (30000000000007 + 10)


def test_op6_query(spark):
    """Counts, digests and spans of the query; every planted token of a small corpus is a span, of one document alone too."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    planted = 0
    for g in registry.QUERIES["op6_pii"](spark, sf).collect():
        text, base = texts[g["doc_id"]], pii.base_spans(texts[g["doc_id"]])
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert tuple(g)[:6] == (g["doc_id"], *(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(",".join(said).encode()).hexdigest())
        spans = g["spans"].split(",") if g["spans"] else []
        assert set(said) <= set(spans) and spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))
        alone = pii.all_spans(text, pii.fit(Counter(pii.votes(text, *s) for s in base + pii.candidates(text, base))))[1]
        assert [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in alone] == spans
        for m in re.finditer('token = "([0-9a-f]{40})"', text):
            planted += 1
            assert f"secret:{m.start(1)}:{m.end(1)}" in spans
    assert planted == 13


def test_pii_is_cut_at_base_spans():
    """Whatever the length of what meets a base span."""
    for n in (8, 290, 310):
        text = f"token={'aB3x' * n}+14155550123 then"
        assert [text[a:b] for a, _, b in pii.candidates(text, pii.base_spans(text))] == ["aB3x" * n]
