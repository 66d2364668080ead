"""Whole-text token ids from a tokenizers file, with a bounded cache of words.

A text of plain Latin letters, digits and signs is cut into words by the file's own pattern, for many texts at once in
NumPy: words are named by 64-bit polynomial hashes, and only words that the cache does not hold go to the file's BPE
model. Any other text is cut into chunks (white space, then other characters), which have their ids independently: a
byte-level vocabulary never joins a character to white space after it, and a word vocabulary drops white space. Plain
chunks go the same way as plain texts, others through the whole tokenizer. Texts with control characters 1C to 1F, on
which definitions of white space differ, are encoded whole. Very long plain texts are cut at such places too, so that
working memory does not grow with a text. The cache starts anew when it is full, so memory is bounded.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from .common import tokenizer_path

ODD = re.compile("[\x1c-\x1f]")
CHUNK = re.compile(r"\s*\S+|\s+")
#: Characters on which all Unicode versions, and context-free lower-casing within the first 0x300 code points, agree.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]*")
#: A place where a long text can be cut: white space after another character.
BREAK = re.compile(r"(?<=\S)(?=\s)")
#: The published patterns that ``word_starts`` can cut by, without white space inside words or with a space before them (fixed values).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of a batch, words and ids of a worker's cache, and the longest word that it holds.
BATCH, CACHE_WORDS, CACHE_IDS, CACHE_CHARS = 1 << 18, 400_000, 4_000_000, 40
#: Classes of characters: end of a text, space, other white space, letter, number, anything else.
END, SPACE, WHITE, LETTER, NUMBER, OTHER = range(6)
KIND = np.array([END] + [
    SPACE if c == 32 else WHITE if chr(c).isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    for c in range(1, 0x300)
], np.uint8)
RANDOM = np.random.default_rng(5).integers(1, 2**63, 0x300, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def word_starts(c: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first classes of the words of code points ``c``, in which a zero ends each text.

    ``spaced``: the byte-level pattern, where one space belongs to the word after it and white space is kept; else the
    word-level one, where white space goes and each number stands alone.
    """
    kind = KIND[c]
    white = (kind == SPACE) | (kind == WHITE)
    shape = np.where(white, np.uint8(SPACE), kind)
    start = np.ones(len(c), bool)
    start[1:] = shape[1:] != shape[:-1]
    word = ~white & (kind != END)
    if spaced:
        last = white[:-1] & word[1:]  # the last of a run of white space starts anew, with the word if it is a space
        start[:-1] |= last
        start[1:] &= ~((kind[:-1] == SPACE) & word[1:])
    else:
        start |= kind == NUMBER
    quote = np.flatnonzero((c[:-2] == 39) & start[:-2])
    if len(quote):
        a, b = c[quote + 1], c[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = (b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))
        start[quote[one | two] + 1] = False
        start[quote[one] + 2] = True
        start[quote[two] + 3] = True
    at = np.flatnonzero(start)
    first = kind[at]
    keep = first != END if spaced else (first != END) & ~white[at]
    return at[keep], np.append(at[1:], len(c))[keep], first[keep]


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache:
    """Ids of words by their hashes: sorted hashes, and where in a pool of ids each word's ids lie (place and number in one)."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.spots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def put(self, ids: list[int], n: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Adds words' ids, ``n`` for each word, to the pool; places and numbers."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        sizes = np.array(n, np.int64)
        places = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        return places, sizes

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and numbers of sorted ``keys``, and which of them are not held."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.spots[at] >> 8, self.spots[at] & 255, self.keys[at] != keys

    def hold(self, keys: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys, self.spots = np.insert(self.keys, at, keys), np.insert(self.spots, at, places << 8 | sizes)

    def full(self) -> bool:
        return len(self.keys) > CACHE_WORDS or self.used > CACHE_IDS


class ChunkEncoder:
    """``encode(texts)`` gives one little-endian uint32 array for each text, as ``encode(text, add_special_tokens=False)``."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        path = tokenizer_path(file)
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.letters = byte_letters()
        self.cache = WordCache()
        self.power = self.inverse = np.zeros(0, np.uint64)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        steps = [x["type"] for x in (shape["normalizer"] or {}).get("normalizers", [])]
        pre = shape["pre_tokenizer"]
        self.lower = steps == ["NFC", "Replace", "Lowercase"]
        self.spaced = None  # not known: everything goes through the whole tokenizer
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not shape["normalizer"]:
            self.spaced = True
        elif self.lower and pre["type"] == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
            if pre["pretokenizers"][0]["pattern"]["Regex"] == WORD_LEVEL:
                self.spaced = False

    def _words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all words in one list, and how many each word has."""
        # to the byte-level alphabet all at once; no word holds the zero between them
        raw = "\0".join(words).encode().decode("latin-1").translate(self.letters).split(self.letters[0])
        ids, n, tokenize = [], [], self.model.tokenize
        for word in raw:
            own = [t.id for t in tokenize(word)]
            ids += own
            n.append(len(own))
        return ids, n

    def _hashes(self, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.power) < len(c):
            n = max(len(c), 2 * BATCH)
            self.power, self.inverse = powers(BASE, n), powers(pow(BASE, -1, 2**64), n)
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(RANDOM[c] * self.power[: len(c)], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start]
        return h ^ (h >> np.uint64(32))

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts, all at once."""
        whole = "\0".join([*texts, ""])
        if self.lower:
            whole = whole.lower()
        c = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start, end, _ = word_starts(c, self.spaced)
        keys, first, back = np.unique(self._hashes(c, start, end), return_index=True, return_inverse=True)
        if self.cache.full():
            self.cache.clear()
        places, sizes, new = self.cache.find(keys)
        if new.any():
            at = first[new]
            words = [whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            places[new], sizes[new] = self.cache.put(*self._words(words))
            short = new.copy()
            short[new] = end[at] - start[at] <= CACHE_CHARS
            self.cache.hold(keys[short], places[short], sizes[short])
        place, n = places[back], sizes[back]
        stop = np.cumsum(n)
        ids = self.cache.pool[np.repeat(place - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        cuts = np.concatenate([[0], stop])[np.searchsorted(start, np.flatnonzero(c == 0))]
        return np.split(ids, cuts[:-1])

    def _rest(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _pieces(self, text: str):
        """Parts of a text that have their ids independently, and whether each is plain."""
        if self.spaced is None or ODD.search(text):
            yield text, False
        elif PLAIN.fullmatch(text):
            at = 0
            while len(text) - at > BATCH and (m := BREAK.search(text, at + BATCH)):
                yield text[at : m.start()], True
                at = m.start()
            yield text[at:] if at else text, True
        else:
            for chunk in CHUNK.findall(text):
                yield chunk, bool(PLAIN.fullmatch(chunk))

    def encode(self, texts: list[str]):
        held: list[tuple[str | np.ndarray, bool, bool]] = []  # piece or its ids, whether it is plain text, whether a text ends with it
        size = 0

        def results():
            plain = iter(self._plain([p for p, is_plain, _ in held if is_plain]))
            for p, is_plain, last in held:
                yield next(plain) if is_plain else p, last

        parts: list[np.ndarray] = []

        def flush():
            nonlocal parts
            for ids, last in results():
                parts.append(ids)
                if last:
                    yield (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)
                    parts = []

        for text in texts:
            pieces = list(self._pieces(text)) or [("", True)]
            for k, (piece, plain) in enumerate(pieces):
                held.append((piece if plain else self._rest(piece), plain and self.spaced is not None, k == len(pieces) - 1))
                size += len(piece) + 1
                if size >= BATCH:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()


_HELD: dict[str, ChunkEncoder] = {}


def encoder(file: str) -> ChunkEncoder:
    """One encoder for each file and Python worker."""
    if file not in _HELD:
        _HELD[file] = ChunkEncoder(file)
    return _HELD[file]
