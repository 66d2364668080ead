"""Near-duplicate documents by b-bit MinHash.

1. Words and shingles are hashed byte-wise in NumPy. Equal shingle sets are one class from the start.
2. A signature of minima gives band keys for candidate generation; its low bits, packed, estimate similarity later.
3. Every class is compared with the least class of each of its buckets. Candidates whose collision-corrected estimate
   leaves the threshold in reach are confirmed on full sets. Confirmed links join classes into components.
4. In buckets that still hold several components, bit counts mark the classes with a candidate in another component; the
   full sets of those are then compared, and only links that join components are emitted. Rows of a bucket's largest
   component meet only the bucket's other rows, all in blocks of bounded size. So no link between different components
   is lost, and neither pairs nor candidates of a group are ever listed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: Bands of ROWS minima each (a pair at the threshold 0.8 shares no band in about 5e-7 of cases, one at 0.3 in 96 of 100), bits kept of a minimum.
BANDS, ROWS, BITS = 48, 6, 2
MINIMA = BANDS * ROWS
#: Standard errors below the threshold at which an estimate rules a candidate out (about 1e-9 of true links).
SIGMAS = 6.0
#: Classes of a block in the comparison of components, rows of a task's group (about), shingles compared at a time.
BLOCK, GROUP, COLUMNS = 512, 4096, 4096
#: Ids (8 bytes each) that are broadcast at most.
BROADCAST_IDS = 2_000_000
MULT = np.random.default_rng(11).integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = np.random.default_rng(12).integers(0, 2**32, MINIMA, dtype=np.uint32)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
WORD_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words; of all words together if there are fewer."""
    raw = np.frombuffer(text.encode().translate(LOWER), np.uint8)
    gap = np.concatenate([[True], SPACE[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    long = ends - starts
    h = np.zeros(len(long), np.uint64)
    for i in np.flatnonzero(long > 64).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    # other words: polynomial hashes by steps over their letters, the longest words first, so that each step has a prefix
    own = np.flatnonzero(long <= 64)
    own = own[np.argsort(-long[own], kind="stable")]
    at_least = np.cumsum(np.bincount(long[own], minlength=1)[::-1])[::-1]  # words with so many letters
    s, g = starts[own], long[own].astype(np.uint64)
    for k in range(len(at_least) - 1):
        n = at_least[k + 1]
        g[:n] = g[:n] * WORD_MULT + raw[s[:n] + k]
    h[own] = g
    h = mix(h)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return np.unique(mix(out + np.uint64(min(words, len(h)))))


def signature(own: np.ndarray) -> np.ndarray:
    """The MINIMA minima of a non-empty set."""
    least = np.full(MINIMA, 2**32 - 1, np.uint32)
    high = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 512):
        part = high[at : at + 512] * MULT[:, None]
        part += ADD[:, None]
        np.minimum(least, part.min(1), out=least)
    return least


def packed(least: np.ndarray) -> bytes:
    """The low BITS bits (after mixing) of each minimum, side by side in 64-bit words."""
    low = (mix(least.astype(np.uint64)) & np.uint64(2**BITS - 1)).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(low << np.arange(0, 64, BITS, dtype=np.uint64)[None], 1).tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * WORD_MULT + least[k::ROWS])
    return h.view(np.int64)


#: The lowest bit of each packed minimum.
LOWEST = np.bitwise_or.reduce(np.uint64(1) << np.arange(0, 64, BITS, dtype=np.uint64))


def in_reach(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the estimated similarity of signatures ``a`` and ``b`` (words last, else broadcast) allows the threshold.

    Equal b-bit values are counted by bits; chance collisions (2 ** -BITS) are taken out of the estimate.
    """
    x = a ^ b
    differ = x & LOWEST
    for k in range(1, BITS):
        differ |= (x >> np.uint64(k)) & LOWEST
    agree = MINIMA - np.bitwise_count(differ).sum(-1, dtype=np.int64)
    chance = 2.0**-BITS
    share = threshold + chance * (1 - threshold)
    least = threshold - SIGMAS * np.sqrt(share * (1 - share) / MINIMA) / (1 - chance)
    return (agree / MINIMA - chance) / (1 - chance) >= least


SIGNED = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bits", pa.binary()), ("keys", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """id, n_shingles, a 128-bit key of the set, packed signature and band keys (null for an empty set)."""

    def rows(batches):
        for b in common.slices(batches):
            out = []
            for i, t in zip(b.column(0).to_pylist(), common.texts(b.column(1))):
                own = shingles(t, words)
                if len(own):
                    least = signature(own)
                    out.append((i, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), packed(least), bands(least).tolist()))
                else:
                    out.append((i, 0, None, None, None))
            yield common.batch(SIGNED, **dict(zip(SIGNED.names, zip(*out) if out else [[]] * 5)))

    return docs.mapInArrow(rows, "id long, n_shingles long, set_key binary, bits binary, keys array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, own): the shingle sets of the documents in ``ids`` as bytes."""
    arrow = pa.schema([("id", pa.int64()), ("own", pa.binary())])

    def sets(batches):
        for b in common.slices(batches):
            yield common.batch(arrow, id=b.column(0), own=[shingles(t, words).tobytes() for t in common.texts(b.column(1))])

    # few ids go to every task; more are joined by shuffling the texts
    held = common.stash(ids, "wanted-ids")
    held = F.broadcast(held) if held.count() <= BROADCAST_IDS else held
    return common.stash(docs.join(held, "id", "left_semi").mapInArrow(sets, "id long, own binary"), "shingle-sets", "none")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    own = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), words)
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a").join(own.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches):
        for b in common.slices(batches):
            good = []
            for x, y, p, q in zip(*(b.column(i).to_pylist() for i in range(4))):
                s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                    inner = len(s) + len(t) - len(np.union1d(s, t))
                    if 100 * inner >= percent * (len(s) + len(t) - inner):
                        good.append((x, y))
            yield common.batch(out, **dict(zip(out.names, zip(*good) if good else [[]] * 2)))

    return both.select("a", "b", "own_a", "own_b").mapInArrow(check, "a long, b long")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by products of their incidence matrices, some columns at a time."""
    sizes = [len(s) for s in left] + [len(s) for s in right]
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, col, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[col]
    row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(col, (at, at + COLUMNS))
        m = np.zeros((len(sizes), COLUMNS), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def dealt(rows: DataFrame, wide: int, groups: int) -> DataFrame:
    """Deals rows (key, id, component, major, n_minor, n_major and more) to blocks whose rows have to meet.

    Rows of a bucket's components other than its largest one, ``major``, meet each other block by block (x <= y, s = -1),
    and the rows of ``major`` in parts s of about ``wide`` rows (y = -1). ``first``: the row is of block x. ``chunk``
    gathers many small blocks for one call.
    """
    minor = F.col("component") != F.col("major")
    blocks, parts = (F.ceil(F.col(n) / size).cast("long") for n, size in (("n_minor", BLOCK), ("n_major", wide)))
    deal = lambda n: F.pmod(F.xxhash64("id"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    spot = lambda x, y, s, first: F.struct(x.alias("x"), y.alias("y"), s.alias("s"), first.alias("first"))
    none = F.lit(-1).cast("long")
    each = F.transform(upto(blocks), lambda o: spot(F.least(F.col("mine"), o), F.greatest(F.col("mine"), o), none, F.col("mine") <= o))
    beside = F.transform(upto(parts), lambda s: spot(F.col("mine"), none, s, F.lit(True)))
    across = F.transform(upto(blocks), lambda x: spot(x, none, F.col("mine"), F.lit(False)))
    rows = rows.withColumn("mine", F.when(minor, deal(blocks)).otherwise(deal(parts)))
    met = rows.withColumn("spot", F.explode(F.when(minor, F.concat(each, beside)).otherwise(across))).select("*", "spot.*").drop("spot", "mine", "n_minor", "n_major", "major")
    return met.withColumn("chunk", F.pmod(F.xxhash64("key", "x", "y", "s"), F.lit(groups)))


def blocks_of(rows: pd.DataFrame):
    """The places of the left and right side of each block of a chunk; both sides are the same where a block meets itself."""
    order = np.lexsort([rows[k] for k in ("s", "y", "x", "key")])
    spots = rows[["key", "x", "y", "s"]].to_numpy()[order]
    cuts = np.flatnonzero((spots[1:] != spots[:-1]).any(1)) + 1
    first = rows["first"].to_numpy()
    for at in np.split(order, cuts) if len(order) else []:
        _, x, y, _ = (int(rows[k].iat[at[0]]) for k in ("key", "x", "y", "s"))
        left = at[first[at]]
        right = left if x == y else at[~first[at]]
        if len(left) and len(right):
            yield left, right


def reach(sig: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of different components are in reach of each other."""
    near = comp[left][:, None] != comp[right][None]
    for i in np.flatnonzero(near.any(1)):
        near[i] &= in_reach(sig[left[i]][None], sig[right], threshold)
    return near


def components(links: DataFrame, tag: str) -> DataFrame:
    """(id, component) of the vertices of ``links`` (a, b): least reachable id, by rounds of least neighbours and jumps.

    Every round sends each vertex the least label next to it, then replaces labels by their own labels; the labels are
    written after each round. Aggregations are partial first, so a vertex with very many links is no burden.
    """
    both = common.stash(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{tag}-links")
    label = common.stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), f"{tag}-labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        low = label.join(near, "id").select("id", "component", F.least("component", "c").alias("low"))
        roots = label.select(F.col("id").alias("low"), F.col("component").alias("root"))
        new = common.stash(low.join(roots, "low").select("id", F.least("low", "root").alias("component"), (F.least("low", "root") != F.col("component")).alias("moved")), f"{tag}-labels")
        common.sweep(links.sparkSession, common.made(links.sparkSession) - 2, common.made(links.sparkSession) - 1)  # the labels before
        label = new.select("id", "component")
        if not new.where("moved").limit(1).count():
            return label


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) for each distinct ``id`` and text of ``docs`` (id, text).

    Words are runs of characters other than space and 09-0D after lower-casing A-Z; a set holds the distinct shingles of
    ``words`` words, of all words where there are fewer. Null and wordless texts have empty sets and no links. Links
    need 100 * intersection >= percent * union. Ids name documents and are not null; repeated rows get equal results;
    an empty table gives no rows.
    """
    signed = common.stash(signatures(docs, words), "signatures")
    own = signed.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    classes = common.stash(own, "set-classes")

    spread = classes.select(F.col("rep").alias("id"), F.explode("keys").alias("key"))
    shared = common.stash(spread.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"), "buckets")
    members = common.stash(spread.join(shared, "key"), "bucket-members")
    first = members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    bits = lambda c: classes.select(F.col("rep").alias(c), F.col("bits").alias(f"bits_{c}"))
    threshold = percent / 100

    def keep(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (2, 3))
                yield b.filter(pa.array(in_reach(x, y, threshold))).select(["a", "b"])

    likely = first.join(bits("a"), "a").join(bits("b"), "b").select("a", "b", "bits_a", "bits_b").mapInArrow(keep, "a long, b long")
    links = common.stash(confirm(common.stash(likely, "candidates"), docs, words, percent), "links")
    label = components(links, "first")

    # buckets of several components: compare across components, block by block
    named = common.stash(members.select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "named-members")
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    per_key = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n_all"))
    # written first, so that a small table is broadcast at once and a large one is joined by exchanges that Spark can split
    mixed = common.stash(per_key.where("n_all > n_major").select("key", "major", "n_major", (F.col("n_all") - F.col("n_major")).alias("n_minor")), "mixed-buckets")
    rows = common.stash(named.join(mixed, "key").join(classes.select(F.col("rep").alias("id"), "bits"), "id"), "mixed-members")
    copies = mixed.agg(F.coalesce(F.sum(F.expr(f"n_minor * (ceil(n_minor / {BLOCK}) + ceil(n_major / {BLOCK})) + n_major * ceil(n_minor / {BLOCK})")), F.lit(0))).first()[0]
    groups = max(1, int(copies) // GROUP)

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        sig, comp, found = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(len(rows), -1), rows["component"].to_numpy(), []
        for left, right in blocks_of(rows):
            near = reach(sig, comp, left, right, threshold)
            found += [left[near.any(1)], right[near.any(0)]]
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        return rows.iloc[at][["id"]].drop_duplicates()

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        sig, comp, found = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(len(rows), -1), rows["component"].to_numpy(), [np.zeros((0, 2), np.int64)]
        sets = [np.frombuffer(x, np.uint64) for x in rows["own"]]
        size = np.array([len(x) for x in sets])
        for left, right in blocks_of(rows):
            near = reach(sig, comp, left, right, threshold)
            left, right, near = left[near.any(1)], right[near.any(0)], near[np.ix_(near.any(1), near.any(0))]
            if len(left):
                inner = intersections([sets[k] for k in left], [sets[k] for k in right])
                i, j = np.nonzero(near & (100 * inner >= percent * (size[left][:, None] + size[right][None] - inner)))
                found.append(np.sort(np.stack([comp[left[i]], comp[right[j]]], 1), 1))
        pairs = np.unique(np.concatenate(found), axis=0)  # a link between components stands for all between them
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    marked = common.stash(dealt(rows, GROUP, groups).groupBy("chunk").applyInPandas(mark, "id long").distinct(), "marked")
    close = rows.join(marked, "id").join(shingle_sets(docs, marked, words), "id")
    more = common.stash(dealt(close, BLOCK, groups).groupBy("chunk").applyInPandas(across, "a long, b long").distinct(), "cross-links")
    if more.limit(1).count():
        joined = components(more, "second").select(F.col("id").alias("component"), F.col("component").alias("whole"))
        every = classes.select(F.col("rep").alias("id")).join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        label = every.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    classes = classes.select("set_key", F.col("rep").alias("id")).join(label, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    return signed.select("id", "n_shingles", "set_key").join(classes, "set_key", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def set_size(text, words: int):
    """Number of a text's shingles, as an expression; for the few rows that are in no comparison."""
    own = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    many = lambda w: F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.array_join(F.slice(w, i, F.lit(words)), " "))))
    return F.get(F.transform(F.array(own), lambda w: F.when(F.size(w) < words, F.least(F.size(w), F.lit(1))).otherwise(many(w))), F.lit(0)).cast("long")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a doc_id cannot be named by a group: each stands alone, kept, with component_id null."""
    docs = common.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = near_duplicates(docs.where("id is not null"), words=4)
    named = found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    alone = docs.where("id is null").select(F.col("id").alias("doc_id"), set_size(F.col("text"), 4).alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return named.unionByName(alone)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of ``docs``: that with the smallest doc_id. Rows of one id and text are one document.

    Of different texts that share an id, those go that are near-duplicates of a text with a smaller id; the others stay.
    Rows whose doc_id is null cannot be named by a group and stay, as do texts without words. Other columns stay,
    whatever their names; of rows with one id and text that with the least other columns stays, as JSON.
    """
    name, kept = common.fresh(docs.columns, "near_id", "kept_row")
    own, rest = docs.where("doc_id is not null"), [c for c in docs.columns if c not in ("doc_id", "text")]
    if rest:
        others = F.struct(*(F.col(f"`{c}`") for c in rest))
        own = own.groupBy("doc_id", "text").agg(F.min_by(others, F.to_json(others)).alias(kept)).select("doc_id", "text", f"`{kept}`.*").select(*(F.col(f"`{c}`") for c in docs.columns))
    else:
        own = own.distinct()
    found = near_duplicates(own.select(F.col("doc_id").alias("id"), "text"), words, percent)
    # an id stays if one of its texts leads a group
    judged = found.groupBy("id").agg(F.max((F.col("id") == F.col("component")).cast("int")).alias("leads"))
    gone = judged.where("leads = 0").select(F.col("id").alias(name))
    return own.join(gone, own["doc_id"] == F.col(name), "left_anti").select(docs.columns).unionByName(docs.where("doc_id is null"))
