"""Alignment of machine captions with manual segments, and strict positional and keyed pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .segments import by_document


def nearest(segments: list[tuple[int, int]], captions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each segment the captions a..b-1 that fit it best, going forward only: a is the last before the distance of starts
    stops shrinking, b the first at which the distance of ends grows. Segments after the last caption get none."""
    found, at, n = [], 0, len(captions)
    for start, end in segments:
        if at >= n:
            break
        a = at
        while a + 1 < n and abs(captions[a + 1][0] - start) < abs(captions[a][0] - start):
            a += 1
        b = a + 1
        while b < n and abs(captions[b][1] - end) <= abs(captions[b - 1][1] - end):
            b += 1
        found.append((a, b))
        at = b
    return found


def nearest_align(docs: DataFrame) -> DataFrame:
    """(id, seg_no, start, end, first, last, texts) of ``docs`` (id, segments: array of start, end; captions: array of start, end,
    text): each segment with the captions that lie nearest. Documents are rows, so nothing is shuffled; null arrays are empty."""

    def rows(key, segments, captions):
        found = nearest(segments, [c[:2] for c in captions])
        return (dict(id=key, seg_no=k, start=segments[k][0], end=segments[k][1], first=a, last=b - 1, texts=[t for _, _, t in captions[a:b]]) for k, (a, b) in enumerate(found))

    result = "id string, seg_no long, start long, end long, first long, last long, texts array<string>"
    return by_document(docs, rows, result, segments=("start", "end"), captions=("start", "end", "text"))


def pair_sorted(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """The n-th of one sorted list of files with the n-th of the other; lists of different lengths are an error."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} and {b} files cannot be paired")
    number = lambda df, path: df.withColumn("n", F.row_number().over(Window.orderBy(path)))  # noqa: E731  lists of files, not of rows
    return number(left, left_path).join(number(right, right_path), "n")


def join_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join in which every key of ``left`` has to be in ``right``."""
    lost = left.join(right, key, "left_anti").select(key).limit(3).collect()
    if lost:
        raise ValueError(f"no partner for {[r[0] for r in lost]}")
    return left.join(right, key)


def with_tags(rows: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of a tag table; rows without tags keep nulls, columns of both are the tags'."""
    new = [c for c in tags.columns if c != key]
    return rows.drop(*new).join(tags, key, "left")


def shard_union(*shards: DataFrame) -> DataFrame:
    """All rows; columns that a shard lacks are null."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def all_blank(texts: Column) -> Column:
    """Whether an array holds nothing but empty texts."""
    return F.forall(texts, lambda t: t == "")
