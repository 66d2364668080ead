"""Language identification by error-correcting output codes over hashed character n-grams.

Each language has a codeword; one binary classifier for each bit scores a document's n-grams; decoding weighs each
bit's loss by that bit's reliability, takes the nearest codeword and flags documents whose two nearest are close.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import common

#: Labelled rows that the classifiers are fitted on at most, features, characters counted at a time.
SAMPLE_ROWS, DIMS, STEP = 4_000, 2_048, 1 << 18
#: Difference of normalised losses below which the two nearest codewords are too close.
AMBIGUOUS = 0.05
LETTER = re.compile(r"[^\W\d_]")
KEEP = np.array([chr(c).isalpha() for c in range(0x3000)])


def ngrams(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams of the whole lower-cased text; what isn't a letter is a space."""
    total, tail = np.zeros(DIMS), np.zeros(0, np.uint32)
    for at in range(0, len(text), STEP):
        c = np.frombuffer(text[at : at + STEP].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.where((c >= 0x3000) | KEEP[np.minimum(c, 0x2FFF)], c, 32).astype(np.uint32)
        gone = (c == 32) & (np.concatenate([tail[-1:] if len(tail) else np.array([32], np.uint32), c[:-1]]) == 32)
        c = np.concatenate([tail, c[~gone]])
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        for h in (c * np.uint32(0x165667B1), two, three):
            total += np.bincount((h ^ (h >> 15)) * np.uint32(0x2C1B3C6D) >> 21, minlength=DIMS)
        tail = c[-2:]
    return np.sqrt(total / max(total.sum(), 1)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """+1/-1 codewords of ``n`` classes: exhaustive up to seven classes, else dense random ones with far rows."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = np.array([[(k >> i) & 1 for k in range(2 ** (n - 1) - 1)] for i in range(n - 1)])
        return np.concatenate([np.ones((1, bits.shape[1])), bits * 2.0 - 1])
    rng, length = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    tries = [rng.choice([-1.0, 1.0], (n, length)) for _ in range(50)]
    return max(tries, key=lambda m: (length - (m @ m.T - 2 * length * np.eye(n)).max()))


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """Ridge classifiers of all bits on features ``x``; classes weigh the same. ``weight``: each bit's reliability."""
    names = sorted(set(langs))
    if not names:
        return {"names": []}
    code, y = codewords(len(names)), np.array([names.index(v) for v in langs])
    w = 1 / np.bincount(y)[y]
    z = np.concatenate([x, np.ones((len(x), 1))], 1).astype(float)
    target = code[y]
    a = (z * w[:, None]).T @ z + 1e-3 * np.eye(z.shape[1])
    beta = np.linalg.solve(a, (z * w[:, None]).T @ target)
    right = ((np.sign(z @ beta) == target) * w[:, None]).sum(0) / w.sum()
    return {"names": names, "code": code, "beta": beta.astype(np.float32), "weight": np.clip(2 * right - 1, 0.05, 1)}


def decode(margin: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, a score in 0..1, and whether the nearest two are too close."""
    loss = np.exp(-np.clip(margin[:, None, :] * model["code"][None], -3, 3)) @ model["weight"] / model["weight"].sum()
    p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    two = np.sort(loss, 1)[:, :2]
    return loss.argmin(1), p.max(1), (two[:, -1] - two[:, 0] < AMBIGUOUS) if loss.shape[1] > 1 else np.zeros(len(loss), bool)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fit on at most ``sample_rows`` labelled rows (doc_id, text, lang), those whose hashed ids lie below a threshold.

    The threshold comes from the number of labelled rows, so that no task sorts or gathers ids. Rows without a language
    or letters take no part; without any row the model knows no language. Feature vectors of the sample (DIMS floats
    each) are all that reaches the driver.
    """
    rows = docs.where("lang is not null").select("doc_id", "text", "lang")
    share = min(1.0, 0.9 * sample_rows / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else rows
    arrow = pa.schema([("lang", pa.string()), ("x", pa.binary())])

    def featurise(batches):
        for b in common.slices(batches):
            own = [(lang, ngrams(text).tobytes()) for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if LETTER.search(text)]
            if own:
                yield common.batch(arrow, lang=[v for v, _ in own], x=[x for _, x in own])

    sample = chosen.where("text is not null").select("text", "lang").mapInArrow(featurise, "lang string, x binary")
    got = sample.limit(sample_rows).toPandas()
    return fit(np.array([np.frombuffer(x, "<f4") for x in got["x"]]).reshape(-1, DIMS), got["lang"].tolist())


def predict(docs: DataFrame, model: dict, added: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``docs`` with the columns ``added``. Texts that are null or without letters are ``und`` with score 0.

    So are all texts if the model knows no language. Every row is judged by its whole text alone, however long, so
    repeated rows get equal values; an empty table stays empty; columns of these names are replaced.
    """
    docs = docs.drop(*added)
    kinds = dict(zip(added, (T.StringType(), T.DoubleType(), T.BooleanType())))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in kinds.items())])

    def run(batches):
        for b in common.slices(batches):
            texts, names = common.texts(b.column("text")), model["names"]
            own = [i for i, t in enumerate(texts) if names and LETTER.search(t)]
            lang, score, close = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if own:
                x = np.stack([ngrams(texts[i]) for i in own])
                for i, k, s, c in zip(own, *decode((x @ model["beta"][:-1] + model["beta"][-1]).astype(float), model)):
                    lang[i], score[i], close[i] = names[k], float(s), bool(c)
            for name, v in zip(added, (lang, score, close)):
                b = b.append_column(name, pa.array(v))
            yield b

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
