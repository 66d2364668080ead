"""Repair of conversation structure by shortest paths.

Turns are put in order, faults are marked, and each turn becomes one letter. Positions in a conversation and the states
of the role pattern ``(s?(ua)+)?`` are the nodes of a graph whose arcs are edits with small whole costs. Dial's bucket
queue finds every node's distance to the end; the audit is the lexicographically least walk along tight arcs.

Long conversations are cut into blocks: a block's distances between the states at its two ends are found by itself, a
conversation's blocks are put together from those few numbers, and each block is then walked by itself, from every state
it may be entered in. Only the chain of states runs through a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

SOLID = r"[^\x20\x09-\x0D]"
#: Turns of a block.
BLOCK = 4096
#: Edits and their costs; a truncated turn that stays adds STAYS.
KEEP, REROLE, DELETE, INSERT, STAYS = 0, 3, 4, 3, 3
#: The role pattern: state -> role initial -> state. Conversations begin in 0 and may end in ENDS.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS, STATES, FAR = (0, 3), 4, 1 << 40
ROLES = {"u": "user", "a": "assistant"}
#: Turns as letters: the role's initial (o: none of the pattern's), large if truncated; x has to go.
LETTERS = "suaoSUAOx"
MARK = re.compile("[ua]*[KDUA]")


def arcs(letter: str | None) -> list[list[tuple[str, str, int, int, int]]]:
    """By state: (edit, mark, turns passed, next state, cost), least edit first; no letter: insertions only."""
    out = []
    for state in range(STATES):
        found = [("I", role, 0, NEXT[state][role], INSERT) for role in NEXT[state] if role in ROLES]
        if letter:
            stay = STAYS * letter.isupper()
            found.append(("D", "D", 1, state, DELETE))
            if letter != "x":
                found += [("K", "K", 1, to, KEEP + stay) for role, to in NEXT[state].items() if role == letter.lower()]
                found += [("R", role.upper(), 1, to, REROLE + stay) for role, to in NEXT[state].items() if role in ROLES and role != letter.lower()]
        out.append(sorted(found))
    return out


FORWARD = {c: arcs(c) for c in LETTERS}
#: letter -> state -> (state before, cost) of arcs that pass a turn, and of insertions.
BACKWARD = {c: [[(s, a[4]) for s in range(STATES) for a in FORWARD[c][s] if a[2] and a[3] == to] for to in range(STATES)] for c in LETTERS}
INSERTED = [[(s, a[4]) for s in range(STATES) for a in arcs(None)[s] if a[3] == to] for to in range(STATES)]


def distances(turns: str, ends: list[int]) -> list[int]:
    """Distance from each node (position * STATES + state) to the end, where state s still has ``ends[s]`` to go.

    Dial's algorithm: arcs cost at most a few units, so a ring of buckets is the queue.
    """
    n = len(turns)
    least = min(ends)
    far = [e - least for e in ends]
    ring = 1 + max(REROLE + STAYS, DELETE, INSERT, *(f for f in far if f < FAR // 2))
    buckets: list[list[int]] = [[] for _ in range(ring)]
    dist, waiting, now = [FAR] * (STATES * (n + 1)), 0, 0
    for state, f in enumerate(far):
        if f < FAR // 2:
            dist[STATES * n + state] = f
            buckets[f].append(STATES * n + state)
            waiting += 1
    while waiting:
        bucket = buckets[now % ring]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue
            at, state = divmod(node, STATES)
            before = [(STATES * (at - 1) + s, c) for s, c in BACKWARD[turns[at - 1]][state]] if at else []
            if at < n:
                before += [(STATES * at + s, c) for s, c in INSERTED[state]]
            for other, cost in before:
                if now + cost < dist[other]:
                    dist[other] = now + cost
                    buckets[(now + cost) % ring].append(other)
                    waiting += 1
        now += 1
    return [d + least if d < FAR else FAR for d in dist]


#: What is left to do at a conversation's end, by state, and the turns that are then inserted.
AT_END = [0, 2 * INSERT, INSERT, 0]
TAIL = ["", "ua", "a", ""]


@lru_cache(maxsize=1 << 14)
def passage(turns: str) -> tuple[int, ...]:
    """Distances from each state at a block's beginning to each state at its end, row by row."""
    to = [distances(turns, [0 if s == end else FAR for s in range(STATES)])[:STATES] for end in range(STATES)]
    return tuple(to[end][start] for start in range(STATES) for end in range(STATES))


def walks(turns: str, ends: list[int]) -> list[tuple[int, str]]:
    """For each state in which the block may be entered: the state it is left in, and the marks of the least audit."""
    dist, found = distances(turns, ends), []
    for state in range(STATES):
        at, marks = 0, []
        while at < len(turns):
            here = dist[STATES * at + state]
            for _, mark, passed, to, cost in FORWARD[turns[at]][state]:
                if cost + dist[STATES * (at + passed) + to] == here:
                    marks.append(mark)
                    at, state = at + passed, to
                    break
        found.append((state, "".join(marks)))
    return found


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with made faults, chosen by a checksum of conv_id and turn; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", F.col("role").alias("told"), F.sha2("text", 256).alias("digest"), F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.withColumn("tie", F.struct("told", "digest", "copy")).drop("told", "digest", "copy")


def in_order(turns: DataFrame, ties: str | None = None) -> DataFrame:
    """Rows (key, at, turn, role, text, who, fault, digest), written; ``at`` grows along each conversation.

    Sorted in ranges, so that a long conversation may lie in several parts. ``ties``: a column that orders turns of one number. A later turn with the role and text of an
    earlier one is a duplicate.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    tie = F.struct(said("role").alias("role"), F.sha2(said("text"), 256).alias("digest")) if ties is None else F.col(ties)
    rows = turns.select(said("conv_id").alias("key"), "turn", said("role").alias("role"), said("text").alias("text"), tie.alias("tie"))
    rows = rows.orderBy("key", F.col("turn").asc_nulls_first(), "tie").withColumn("at", F.monotonically_increasing_id())
    initial = F.substring("role", 1, 1)
    fault = F.when(~F.col("text").rlike(SOLID), "blank").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    rows = rows.select("key", "at", "turn", "role", "text", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("who"), fault.alias("fault"), F.sha2("text", 256).alias("digest"))
    return common.stash(rows, "turns")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """(key, at, turn, who, fault) with duplicates marked: the first of each text is found by groups and met again by its place alone, so no text is hot."""
    first = rows.where("fault <> 'blank'").groupBy("key", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != "blank") & F.col("first").isNull(), "duplicate").otherwise(F.col("fault"))
    return rows.select("key", "at", "turn", "who", "fault").join(first, "at", "left").select("key", "at", "turn", "who", fault.alias("fault"))


def each(df: DataFrame, what, schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows that ``what`` makes of each row."""

    def run(batches):
        for b in common.slices(batches):
            rows = [r for x in b.to_pylist() for r in what(**x)]
            yield common.batch(arrow, **dict(zip(arrow.names, zip(*rows) if rows else [[]] * len(arrow))))

    return df.mapInArrow(run, schema)


def blocks(marked: DataFrame) -> DataFrame:
    """(key, b, start, turns, who, pass, illegal) for each run of at most BLOCK turns of a conversation, written."""
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("who")).otherwise(F.col("who"))
    runs = marked.groupBy("key", F.call_function("div", F.col("at"), F.lit(BLOCK)).alias("b")).agg(F.min("at").alias("start"), F.array_sort(F.collect_list(F.struct("at", letter.alias("x"), "who"))).alias("r"))
    runs = runs.select("key", "b", "start", F.array_join("r.x", "").alias("turns"), F.array_join("r.who", "").alias("who"))
    as_rows = lambda key, b, start, turns, who: [(key, b, start, turns, who[0], who[-1], passage(turns), wrong_turns(who))]
    arrow = pa.schema([("key", pa.string()), ("b", pa.int64()), ("start", pa.int64()), ("turns", pa.string()), ("first", pa.string()), ("last", pa.string()), ("pass", pa.list_(pa.int64())), ("illegal", pa.int64())])
    return common.stash(each(runs, as_rows, "key string, b long, start long, turns string, first string, last string, pass array<long>, illegal long", arrow), "blocks")


def wrong_turns(who: str) -> int:
    return sum(who[i : i + 2] not in ("su", "ua", "au") for i in range(len(who) - 1))


def left_to_do(blocks: list[dict]) -> tuple[list[list[int]], int]:
    """What is left at the end of each block, by state, and in all: min-plus products from the conversation's end."""
    out, ends = [], AT_END
    for x in reversed(blocks):
        out.append(ends)
        ends = [min(x["pass"][STATES * s + e] + ends[e] for e in range(STATES)) for s in range(STATES)]
    return out[::-1], ends[0]


def audits(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of written blocks: (key, cost, illegal, audit) by conversation, and (key, start, marks, tail) by block."""
    chain = lambda df, *c: df.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("b", *c))).alias("blocks"))

    def ended(key, blocks):
        left, cost = left_to_do(blocks)
        return [(key, x["b"], ends, cost) for x, ends in zip(blocks, left)]

    arrow = pa.schema([("key", pa.string()), ("b", pa.int64()), ("ends", pa.list_(pa.int64())), ("cost", pa.int64())])
    left = each(chain(found, "pass"), ended, "key string, b long, ends array<long>, cost long", arrow)

    def walked(key, b, turns, ends):
        return [(key, b, [{"to": to, "marks": marks} for to, marks in walks(turns, ends)])]

    arrow = pa.schema([("key", pa.string()), ("b", pa.int64()), ("ways", pa.list_(pa.struct([("to", pa.int64()), ("marks", pa.string())])))])
    placed = found.join(left, ["key", "b"])
    ways = each(placed.select("key", "b", "turns", "ends"), walked, "key string, b long, ways array<struct<to:long,marks:string>>", arrow)
    lined = chain(ways.join(placed.select("key", "b", "start", "first", "last", "illegal", "cost"), ["key", "b"]), "start", "first", "last", "illegal", "cost", "ways")

    def chained(key, blocks):
        state, pieces = 0, []
        for x in blocks:
            way = x["ways"][state]
            pieces.append({"start": x["start"], "marks": way["marks"], "tail": ""})
            state = way["to"]
        pieces[-1]["tail"] = TAIL[state]
        illegal = sum(x["illegal"] for x in blocks) + sum(wrong_turns(x["last"] + y["first"]) for x, y in zip(blocks, blocks[1:]))
        return [(key, blocks[0]["cost"], illegal, "".join(x["marks"] for x in pieces) + TAIL[state], pieces)]

    piece = pa.list_(pa.struct([("start", pa.int64()), ("marks", pa.string()), ("tail", pa.string())]))
    arrow = pa.schema([("key", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("marks", pa.string()), ("pieces", piece)])
    done = common.stash(each(lined, chained, "key string, cost long, illegal long, marks string, pieces array<struct<start:long,marks:string,tail:string>>", arrow), "audits")
    return done.select("key", "cost", "illegal", F.translate("marks", "uaUA", "IIRR").alias("audit")), done.select("key", F.explode("pieces").alias("p")).select("key", "p.*")


def repaired(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, role, text) of the repaired conversations, in order within a part, a conversation in one part.

    Turns stream past, each block behind its marks: only a block's marks are held, however long a conversation.
    """
    nothing = lambda c: F.lit(None).cast("string").alias(c)
    marks = pieces.select("key", F.col("start").alias("at"), F.lit(0).alias("kind"), "marks", nothing("role"), nothing("text"))
    tails = pieces.where("tail <> ''").select("key", F.lit((1 << 63) - 1).alias("at"), F.lit(0).alias("kind"), F.col("tail").alias("marks"), nothing("role"), nothing("text"))
    turns = rows.select("key", "at", F.lit(1).alias("kind"), nothing("marks"), "role", "text")
    parts = marks.unionByName(tails).unionByName(turns).repartition("key").sortWithinPartitions("key", "at", "kind")
    arrow = pa.schema([("key", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        todo = iter(())
        for b in common.slices(batches):
            out = []
            for x in b.to_pylist():
                if x["kind"] == 0:
                    if x["marks"][-1] in ROLES:
                        out += [(x["key"], ROLES[c], "") for c in x["marks"]]
                    todo = MARK.finditer(x["marks"])
                    continue
                mark = next(todo).group()
                out += [(x["key"], ROLES[c], "") for c in mark[:-1]]
                if mark[-1] != "D":
                    out.append((x["key"], x["role"] if mark[-1] == "K" else ROLES[mark[-1].lower()], x["text"]))
            yield common.batch(arrow, **dict(zip(arrow.names, zip(*out) if out else [[]] * 3)))

    return parts.mapInArrow(run, "key string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of ``repaired`` turns: one running digest, as they stream past."""
    arrow = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        key, sha = None, None
        for b in common.slices(batches):
            out = []
            for k, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != key:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if out:
                yield common.batch(arrow, key=[k for k, _ in out], repaired_sha256=[d for _, d in out])
        if key is not None:
            yield common.batch(arrow, key=[key], repaired_sha256=[sha.hexdigest()])

    return turns.mapInArrow(run, "key string, repaired_sha256 string")


def repair(turns: DataFrame, ties: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Report and repaired turns of ``turns`` (conv_id, turn, role, text).

    The report has a row for each conversation: key (conv_id as text, null as one space), gaps, blank, duplicate, truncated,
    illegal, cost, audit; the repaired turns are (key, role, text) in order. Turns go by number (nulls first), ties by
    role and a hash of the text unless ``ties`` names a column; null roles and texts are one space; repeated rows are duplicates; roles that are none of
    the pattern's, an empty one too, are given another or go; texts of any length are only streamed. An empty table gives
    no rows; other columns are ignored.
    """
    rows = in_order(turns, ties)
    marked = common.stash(with_duplicates(rows), "faults")
    told, pieces = audits(blocks(marked))
    count = lambda kind: F.sum((F.col("fault") == kind).cast("long")).alias(kind)
    faults = marked.groupBy("key").agg(*(count(k) for k in ("blank", "duplicate", "truncated")))
    numbers = marked.where("turn is not null").select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    report = told.join(faults, "key").join(numbers, "key", "left")
    return report.select("key", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"), repaired(rows, pieces)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every conversation of the damaged table, with a digest of its repaired turns; those without turns have zeros."""
    turns = common.load(spark, sf_dir, "conversations")
    report, fixed = repair(damage(turns), "tie")
    every = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")).distinct()
    found = every.join(report, "key", "left").join(digests(fixed), "key", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(
        "conv_id", *(number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The checksum as a fold over bytes, each followed by eight shifts (-1).
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length({s}) + 1), lambda i: [CAST(unicode({s}[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""
OP12_SQL = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS told, coalesce(text, ' ') AS said, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
k AS (SELECT *, {CRC32.format(s="s")} % 20 AS kind FROM c),
d AS (SELECT conv_id, turn, told, sha256(said) AS digest, copy, CASE WHEN kind = 4 THEN 'user' ELSE told END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(said, '[.!?]', '', 'g') ELSE said END AS text FROM k, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, told, digest, copy) AS i FROM d),
m AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
  left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS two FROM o),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM m GROUP BY conv_id),
-- the role pattern: what a state takes, and the insertions that lead from one state to another
nxt(q, role, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, q2, cost, audit, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']),
  (2, 3, 3, 'I', ['assistant:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
e AS (SELECT conv_id, i, q, q2, cost, edit, line FROM (
  SELECT conv_id, i, q, q AS q2, 4 AS cost, 'D' AS edit, []::VARCHAR[] AS line FROM m, range(4) r(q)
  UNION ALL SELECT conv_id, i, q, q2, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [m.role || ':' || text] FROM m JOIN nxt ON left(m.role, 1) = nxt.role WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, q, q2, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', [CASE nxt.role WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM m JOIN nxt ON nxt.role <> 's' WHERE fault IN ('', 'truncated'))),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, ins.q2 AS q, {{'cost': CAST(ins.cost AS BIGINT), 'audit': ins.audit, 'lines': ins.lines}} AS best FROM f, ins WHERE ins.q = 0
  UNION ALL SELECT w.conv_id, w.i + 1, ins.q2, min({{'cost': CAST(w.best.cost + e.cost + ins.cost AS BIGINT), 'audit': w.best.audit || e.edit || ins.audit, 'lines': list_concat(list_concat(w.best.lines, e.line), ins.lines)}})
  FROM w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.q = w.q JOIN ins ON ins.q = e.q2 GROUP BY w.conv_id, w.i + 1, ins.q2),
b AS (SELECT w.conv_id, min(best) AS best FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = f.n WHERE q IN (0, 3) GROUP BY w.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.best.cost, 0)::BIGINT AS cost, coalesce(b.best.audit, '') AS audit, sha256(coalesce(array_to_string(b.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""
