"""Personal data by weak supervision.

Fixed patterns find the base spans. Further candidates (long numbers, written-out addresses, strings that could be
secrets) and the base spans get votes from regex, gazetteer and context labelers, none of which is the pattern that
made the candidate. Spark counts the vote patterns of the whole corpus; expectation-maximisation over those counts
estimates each labeler's reliability, and its posteriors train the span classifier, on votes and on features of the span
and of its context, that decides which candidates become spans. Base spans always stay.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "secret", "number", "address")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: As the stated patterns; the look-behind only spares tries inside a run of digits, which fail as the run's start does.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Candidates beyond the base patterns: what is assigned to a name, strings that hold digits and letters, long numbers, written-out addresses.
ASSIGNED = re.compile(r"[A-Za-z][A-Za-z_-]{1,30}[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9/+_-]{6,})")
KEYLIKE = re.compile(r"(?<![A-Za-z0-9/+_-])(?=[A-Za-z/+_-]*[0-9])(?=[0-9/+_-]*[A-Za-z])[A-Za-z0-9/+_-]{16,}")
NUMBER = re.compile(r"(?<![0-9A-Za-z.+])[0-9](?:[0-9]|[ ().-][0-9]|\) [0-9]){6,}(?![0-9A-Za-z])")
SPELT = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63} ?[\[(]?\bat\b[\])]? ?[a-z0-9-]{1,63}(?: ?[\[(]?\bdot\b[\])]? ?[a-z0-9-]{1,63})+")
#: Gazetteers (fixed lists): top-level domains, beginnings of issued keys, and names that secrets and personal data are given.
DOMAINS = frozenset("com org net edu gov io co de fr es uk eu info".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk-", "sk_live_", "AIza", "glpat-", "eyJ")
SECRET_NAMES = re.compile(r"(?i)(?:passw(?:or)?d|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth|credential|bearer)[\w -]{0,12}[=:\"' \t]{0,6}$")
CUES = re.compile(r"(?i)(?:e-?mail|mail|phone|tel|call|mobile|fax|card|iban|ssn|account|ip|address|login|contact|write|reach)\W{0,4}\w{0,3}\W{0,3}$")
#: Words that speak for a measure, a price or an ordinary number.
COUNTS = re.compile(r"(?i)(?:[$€£#%]|\b(?:no|nr|number|page|pages|year|vol|isbn|version|rows|items|total|about|id)\b[.:]?)\s{0,2}$")
#: Characters before a span that the labelers look at.
CONTEXT = 64
#: What is believed of a labeler before any count: how often its votes are right, with the weight of so many votes, beside so many votes of the corpus, however large.
TRUST, PRIOR_VOTES, CORPUS_VOTES = 0.85, 200.0, 1000.0
#: Within these no labeler decides alone, and two that agree do when none objects.
RELIABILITY = (0.76, 0.88)
#: Posterior that a candidate needs to become a span.
ACCEPT = 0.9
LABELERS = ("pattern", "named", "key prefix", "domain list", "checksum", "cue before", "mixed shape", "plain number")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = sum(int(c) for c in number[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in number[-2::-2])
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping addresses; linear, as each sign is read from its at sign on."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base patterns, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = digits(m.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(found)


def outside(text: str, a: int, k: int, b: int, taken: list[list[int]]) -> list[tuple[int, int, int]]:
    """The parts of a candidate that lie between base spans and are long enough to be candidates."""
    i = bisect.bisect_right(taken, a, key=lambda t: t[1])
    if i == len(taken) or taken[i][0] >= b:
        return [(a, k, b)]
    found = []
    while a < b:
        low, high = taken[i] if i < len(taken) else (b, b)
        end = min(low, b)
        if k == 4 and end - a >= 6:
            found.append((a, k, end))
        elif k == 5 and len(digits(text[a:end])) >= 7:
            own = [m.start() for m in DIGIT.finditer(text, a, end)]
            found.append((own[0], k, own[-1] + 1))
        a, i = max(high, end), i + 1
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans beyond the base ones that the classifier may add; none overlaps a base span or another candidate."""
    found = [(m.start(1), 4, m.end(1)) for m in ASSIGNED.finditer(text)] if "=" in text or ":" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 4, m.end()) for m in KEYLIKE.finditer(text)]
        found += [(m.start(), 5, m.end()) for m in NUMBER.finditer(text)]
    if "dot" in text or "Dot" in text or "DOT" in text:
        found += [(m.start(), 6, m.end()) for m in SPELT.finditer(text)]
    if not found:
        return []
    own, last, i = [], -1, 0
    taken = []  # merged base spans
    for a, _, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for a, k, b in sorted(part for f in found for part in outside(text, *f, taken)):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and (i == len(taken) or taken[i][0] >= b):
            own.append((a, k, b))
            last = b
    return own


def votes(text: str, start: int, kind: int, end: int) -> str:
    """One letter for each labeler (p for, n against, - no vote), then features: length, digits, letter case, signs before and after, kind."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 1]
    d = digits(span)
    letters = [c for c in span if c.isalpha()]
    last = span.replace(")", "").replace("]", "").rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower()
    named = SECRET_NAMES.search(before)
    said = (
        "p" if kind < 4 else "-",
        ("p" if named else "-") if kind == 4 else "-",
        "p" if kind == 4 and span.startswith(PREFIXES) else "-",
        ("p" if last in DOMAINS else "n") if kind in (0, 6) else "-",
        ("p" if luhn(d) else "n") if 13 <= len(d) <= 19 and kind in (2, 5) else "-",
        ("p" if CUES.search(before) else "-"),
        ("p" if len(span) >= 8 and len(d) >= 2 and letters else "n" if not d else "-") if kind == 4 else "-",
        "n" if kind in (4, 5) and (len(d) == len(span) and len(d) < 9 or COUNTS.search(before)) else "-",
    )
    size = "abcd"[(len(span) > 8) + (len(span) > 16) + (len(span) > 40)]
    share = "0123"[(len(d) > 0) + (4 * len(d) > len(span)) + (4 * len(d) > 3 * len(span))]
    case = "m" if any(c.islower() for c in letters) and any(c.isupper() for c in letters) else "u" if letters and letters[0].isupper() else "l" if letters else "-"
    sign = lambda c: "w" if c.isspace() or not c else "a" if c.isalnum() else "q" if c in "\"'" else "=" if c in "=:" else "."
    return "".join(said) + size + share + case + sign(before[-1:]) + sign(after) + str(kind)


def scan(docs: DataFrame, what, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches):
        for b in common.slices(batches):
            rows = [r for doc, t in zip(b.column(0).to_pylist(), common.texts(b.column(1))) for r in what(doc, t)]
            yield common.batch(arrow, **dict(zip(arrow.names, zip(*rows) if rows else [[]] * len(arrow))))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def vote_counts(docs: DataFrame) -> dict[str, int]:
    """How often each vote pattern occurs in the corpus; their number is bounded by the letters of a pattern, not by the corpus."""

    def of(_, text):
        base = base_spans(text)
        return [(votes(text, *s),) for s in base + candidates(text, base)]

    seen = scan(docs, of, "votes string", pa.schema([("votes", pa.string())]))
    return {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.count("*").alias("n")).collect()}


def fit(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Probability that spans with a vote pattern are personal data.

    EM over the counts of votes estimates how reliable each labeler is where it votes, from a common belief that weighs
    alike beside a corpus of any size (personal data and other strings count as equally likely, abstentions say nothing).
    Its posteriors train a logistic span classifier on votes and features. Without spans there is nothing to decide.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    share = n * CORPUS_VOTES / n.sum()
    v = np.array([["n-p".index(c) - 1 for c in p[: len(LABELERS)]] for p in patterns], float)
    right = np.full(v.shape[1], TRUST)
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-v @ np.log(right / (1 - right))))
        agreed = share @ ((v > 0) * post[:, None] + (v < 0) * (1 - post)[:, None])
        right = np.clip((PRIOR_VOTES * TRUST + agreed) / (PRIOR_VOTES + share @ np.abs(v)), *RELIABILITY)
    post = 1 / (1 + np.exp(-v @ np.log(right / (1 - right))))
    marks = sorted({(k, p[k]) for p in patterns for k in range(len(LABELERS), len(p))})
    shape = np.array([[p[k : k + 1] == c for k, c in marks] for p in patterns], float).reshape(len(patterns), len(marks))
    x = np.concatenate([np.ones((len(patterns), 1)), v, shape], 1)
    # rare patterns count too: by the logarithm of their number
    w, beta = np.log1p(n) / np.log1p(n).sum(), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - post)) + 1e-7 * beta
        hess = (x * (w * p * (1 - p) + 1e-12)[:, None]).T @ x + 1e-7 * np.eye(len(beta))
        beta -= np.linalg.solve(hess, grad)
    return dict(zip(patterns, (1 / (1 + np.exp(-x @ beta))).tolist()))


def all_spans(text: str, model: dict[str, float]) -> tuple[list, list]:
    """Base spans, and all spans in order."""
    base = base_spans(text)
    added = [s for s in candidates(text, base) if model.get(votes(text, *s), 0.0) >= ACCEPT]
    return base, sorted(base + added)


def find_pii(docs: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end in code points, end exclusive), one row for each row of ``docs``.

    Texts are read whole, however long, in time that grows with their length.

    A null text is empty and has no spans; rows are judged each for itself, so repeated rows and shared ids do no harm;
    an empty table gives no rows; other columns are ignored. ``model``: what ``fit`` returns, else fitted on ``docs``.
    """
    held = fit(vote_counts(docs)) if model is None else model
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    as_rows = lambda s: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in s]

    def of(doc, text):
        base, every = all_spans(text, held)
        return [(doc, as_rows(base), as_rows(every))]

    arrow = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)])
    return scan(docs, of, "doc_id long, base array<struct<start:long,kind:string,end:long>>, spans array<struct<start:long,kind:string,end:long>>", arrow)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; overlapping spans are one.

    A null text stays null; all columns and rows of ``docs`` stay.
    """
    held = fit(vote_counts(docs))

    def mask(batches):
        for b in common.slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                parts, last = [], 0
                for a, k, e in all_spans(text, held)[1] if text else []:
                    if a >= last:
                        parts += [text[last:a], f"<{KINDS[k].upper()}>"]
                    last = max(last, e)
                out.append(None if text is None else "".join([*parts, text[last:]]))
            yield b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(out, b.schema.field("text").type))

    return docs.mapInArrow(mask, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(common.load(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    added = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS[:4]), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"),
        *(added(k) for k in KINDS[4:]), F.size("spans").cast("long").alias("n_spans"))
