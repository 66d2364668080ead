"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text is walked from left to right; only a window of the longest piece's length is held. Each boundary
keeps one backpointer: for unigram models the piece with the best score sum, for merge (BPE) models the only piece that
the merges would end the prefix with, which is the one that agrees with the piece before it. Ids are committed as soon
as all surviving backpointer paths pass one boundary. Ids equal those of the library for the same model file.
"""

from __future__ import annotations

import re
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

SPACE = "▁"
#: Longest word that is cached, pairs of pieces that are, words of a generation of the cache.
CACHE_CHARS, PAIRS = 40, 300_000
CACHE_WORDS = 300_000
#: Rows that are encoded and decoded at a time.
PART = 256


class Recent(dict):
    """A dictionary of about ``size`` entries over the one before it; what is used again moves up."""

    def __init__(self, size: int):
        self.size, self.old = size, {}

    def older(self, key):
        got = self.old.get(key)
        if got is not None:
            self[key] = got
        return got

    def turn(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


class Codec:
    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(model))
        proto = self._proto(sp.serialized_model_proto())
        self.merges = proto.trainer_spec.model_type == 2
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not spec.escape_whitespaces:
            raise ValueError("only models without a character map are supported")
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.unk = sp.unk_id()
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
        self.longest = max(map(len, self.id_of), default=1)
        self.byte_id = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
        self.bytes_of = {i: b for b, i in enumerate(self.byte_id) if i}
        self.fallback = bool(self.bytes_of)
        self.worst = min(self.score.values(), default=0.0) - 10
        # no piece crosses from another character into a space sign, so words can be walked each for itself
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.steps: dict[str, tuple] = {}  # of the pieces and single characters
        self.known: dict[tuple[str, str], bool] = {}  # agree() of pairs met
        self.words = Recent(CACHE_WORDS)

    @cached_property
    def ends(self) -> dict[str, bool]:
        """All endings of pieces, and whether each is a piece that can be used."""
        usable = self.whole if self.merges else self.score
        return {p[k:]: p[k:] in usable for p in self.id_of for k in range(len(p))}

    @cached_property
    def cut(self) -> re.Pattern:
        """Cuts before every run of space signs and between characters of different groups.

        A group holds the characters that are linked by standing side by side in pieces. No piece, so no merge and no
        path either, crosses from one group into another.
        """
        group: dict[str, str] = {}

        def top(c: str) -> str:
            while group.setdefault(c, c) != c:
                group[c] = c = group[group[c]]
            return c

        for p in self.id_of:
            own = p.lstrip(SPACE)
            for a, b in zip(own, own[1:]):
                group[top(a)] = top(b)
        members: dict[str, list[str]] = {}
        for c in list(group):
            members.setdefault(top(c), []).append(c)
        classes = ["[" + "".join(map(re.escape, sorted(m))) + "]+" for m in sorted(members.values(), key=len, reverse=True)]
        return re.compile(SPACE + "*(?:" + "|".join([*classes, "."]) + ")", re.S)

    @cached_property
    def whole(self) -> set[str]:
        """Pieces that the merges of their own characters give."""
        return {p for p in self.score if self.merges and self._merge(p) == [p]}

    @staticmethod
    def _proto(raw: bytes):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        m.ParseFromString(raw)
        return m

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short text by the merges themselves: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _steps(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """Scores of the piece's own merges in order, and its first and its last part before and after each."""
        got = self.steps.get(piece)
        if got is None:
            parts, scores, first, last = list(piece), [], [piece[0]], [piece[-1]]
            while len(parts) > 1:
                best, i = max((self.score.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1))
                if best == float("-inf"):
                    break
                parts[-i : 2 - i] = [parts[-i] + parts[1 - i]]
                scores.append(best)
                first.append(parts[0])
                last.append(parts[-1])
            got = self.steps[piece] = (scores, first, last)
        return got

    def agree(self, a: str, b: str) -> bool:
        """Whether the merges leave the pieces ``a`` and ``b`` as they are side by side: none ever crosses their border."""
        left, _, edge_a = self._steps(a)
        right, edge_b, _ = self._steps(b)
        i = j = 0
        none, score = float("-inf"), self.score
        while True:
            s, t = left[i] if i < len(left) else none, right[j] if j < len(right) else none
            cross = score.get(edge_a[i] + edge_b[j])
            if cross is not None and cross > s and cross >= t:
                return False
            if s == t == none:
                return True
            if s >= t:
                i += 1
            else:
                j += 1

    def _walk(self, text: str):
        """Yields runs of pieces as soon as every surviving path shares them."""
        ends, score, known, longest, worst = self.ends.get, self.score, self.known, self.longest, self.worst
        merges, done = self.merges, 0
        last, total = [""], [0.0]  # of the boundaries from ``done`` on: the piece that ends there, the score sum
        for end in range(1, len(text) + 1):
            best, gain = None, float("-inf")
            for at in range(end - 1, max(end - longest, 0) - 1, -1):
                piece = text[at:end]
                use = ends(piece)
                if use or at == end - 1:
                    before = last[at - done]
                    if not merges:
                        sum_ = total[at - done] + score.get(piece, worst)
                        if sum_ >= gain:  # the longest of equals
                            best, gain = piece, sum_
                    elif not before:
                        best, gain = piece, 0.0
                        break
                    else:
                        fits = known.get((before, piece))
                        if fits is None:
                            fits = known[before, piece] = self.agree(before, piece)
                        if fits:
                            best, gain = piece, 0.0
                            break
                if use is None:
                    break
            last.append(best)
            total.append(gain)
            if end % longest == 0 and end - done > 2 * longest:
                meet = self._meet(last, done, end - longest + 1, end)
                if meet > done:
                    yield self._back(last, done, meet)
                    last, total, done = last[meet - done :], total[meet - done :], meet
        if done < len(text):
            yield self._back(last, done, len(text))

    @staticmethod
    def _back(last: list, done: int, k: int) -> list[str]:
        out = []
        while k > done:
            piece = last[k - done]
            out.append(piece)
            k -= len(piece)
        return out[::-1]

    @staticmethod
    def _meet(last: list, done: int, low: int, high: int) -> int:
        """The last boundary that the paths from all live boundaries low..high share."""
        live = set(range(low, high + 1))
        while len(live) > 1:
            k = max(live)
            live.remove(k)
            live.add(k - len(last[k - done]))
        return live.pop()

    def _ids(self, piece: str) -> list[int]:
        got = self.id_of.get(piece)
        if got is not None:
            return [got]
        return [self.byte_id[b] for b in piece.encode()] if self.fallback else [self.unk]

    def _encode(self, word: str) -> bytes:
        got = self.words.get(word) or self.words.older(word)
        if got is None:
            got = array("I", [i for run in self._walk(word) for p in run for i in self._ids(p)]).tobytes()
            if len(word) <= CACHE_CHARS:
                self.words[word] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        self.words.turn()
        if len(self.known) > PAIRS:
            self.known.clear()
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return np.zeros(0, "<u4")
        parts = ((" " if self.prefix else "") + text).replace(" ", SPACE)
        if not self.by_word:
            return np.frombuffer(self._encode(parts), "<u4")
        words, held = self.cut.findall(parts), self.words
        out = list(map(held.get, words))
        if None in out:
            out = [self._encode(w) if x is None else x for x, w in zip(out, words)]
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are no UTF-8 give the replacement character, control ids nothing."""
        out, raw = [], bytearray()
        pieces, bytes_of = self.pieces, self.bytes_of
        for i in ids.tolist() if isinstance(ids, np.ndarray) else ids:
            if i in bytes_of:
                raw.append(bytes_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            kind = self.kinds[i]
            out.append(pieces[i] if kind in (1, 4) else " ⁇ " if kind == 2 else "")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


_HELD: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _HELD:
        _HELD[model] = Codec(model)
    return _HELD[model]


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of each row of ``docs``; ids as little-endian uint32.

    Null and empty texts have no ids; rows are encoded each for itself; an empty table gives no rows; other columns are
    ignored.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        c = codec(model)
        for b in batches:
            yield common.batch(arrow, doc_id=b.column(0), ids=[c.encode(t).tobytes() for t in common.texts(b.column(1))])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text) from (doc_id, ids)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches):
        c = codec(model)
        for b in batches:
            yield common.batch(arrow, doc_id=b.column(0), ids=b.column(1), text=[c.decode(np.frombuffer(i, "<u4")) for i in b.column(1).to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def transcode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text): ``encode_texts`` and ``decode_ids`` in one pass, so that a task keeps one Python worker.

    Texts come out again in parts of ``PART`` rows; null and empty texts, empty tables and other columns as there.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches):
        c = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, PART):
                b = whole.slice(at, PART)
                ids = [c.encode(t) for t in common.texts(b.column(1))]
                yield common.batch(arrow, doc_id=b.column(0), ids=[i.tobytes() for i in ids], text=[c.decode(i) for i in ids])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``; the decoded text is the text itself."""
    model = "piece_bpe_32k.model"
    back = transcode(common.load(spark, sf_dir, "documents"), model)
    return back.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256"))
