"""Spoken numbers as digits: a transducer over words, and its inverse for whole numbers.

Words are read once, from left to right. What has been said of a number is carried along: as a whole number while words
add up, as a text of digits once they are strung together or hold a point. Signs and currencies go before, ordinal and
plural endings and percent after.
"""

from __future__ import annotations

import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: The words of numbers.
ZEROS = ("o", "oh", "zero")
SMALL = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split()
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
SIGNS = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
CURRENCIES = {"pound": "£", "pounds": "£", "euro": "€", "euros": "€", "dollar": "$", "dollars": "$", "cent": "¢", "cents": "¢"}
REPEATS = {"double": 2, "triple": 3}
FIGURES, PLAIN = re.compile(r"[-+£€$¢]?(\d+(?:\.\d+)?)$"), re.compile(r"\d+(\.\d+)?")


def ordinal(word: str) -> str:
    return IRREGULAR.get(word) or (word[:-1] + "ieth" if word.endswith("y") else word + "th")


def ending(n: int) -> str:
    return "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


def lexicon() -> dict[str, tuple[str, int, str]]:
    """word -> (kind, amount, what is written behind it)."""
    plain = {w: ("small", n) for n, w in enumerate(SMALL, 1)} | {w: ("ten", 10 * n) for n, w in enumerate(TENS, 2)}
    plain |= {"hundred": ("scale", 100)} | {w: ("scale", 1000**n) for n, w in enumerate(SCALES, 1)}
    out = {w: (*entry, "") for w, entry in plain.items()}
    for w, (kind, n) in plain.items():
        out[w + "es" if w == "six" else w[:-1] + "ies" if w.endswith("y") else w + "s"] = (kind, n, "s")
        out[ordinal(w)] = (kind, n, ending(n) if kind == "small" else "th")
    return out | {"zeroth": ("small", 0, "th")} | {w: ("zero", 0, "") for w in ZEROS}


WORDS = lexicon()
#: Whatever may go on with a number; "per" only before "cent".
OTHERS = {*SIGNS, *CURRENCIES, *REPEATS, "and", "point", "per", "percent"}
#: Words whose meaning hangs on the next one.
LOOK_AHEAD = {*SIGNS, *REPEATS, "and", "point", "per"}
DIGIT = re.compile("[0-9]")
ANY = re.compile(r"\d|\b(?:" + "|".join(sorted({*WORDS, *OTHERS} - {"and", "per"})) + r")\b")


class Number:
    """What has been said so far; ``out`` gets finished words."""

    def __init__(self):
        self.value, self.sign, self.out = None, "", []

    def close(self, more: str = "") -> None:
        if self.value is not None:
            self.out.append(f"{self.sign}{self.value}{more}")
            self.value, self.sign = None, ""

    def word(self, w: str) -> None:
        self.close()
        self.out.append(self.sign + w)
        self.sign = ""

    def string(self, digits: str) -> None:
        self.value = f"{'' if self.value is None or self.value == 0 else self.value}{digits}"

    def add(self, kind: str, n: int, before: str | None) -> None:
        """Tens and smaller numbers: added where the number has room for them, else strung on."""
        v = self.value
        follows = WORDS.get(before or "", ("", 0, ""))
        if v is None:
            self.value = n
        elif kind == "small" and (isinstance(v, str) or follows[0] == "small" and not follows[2]):
            # "twenty" strung on before leaves its zero to the digit
            self.value = (str(v)[:-1] if follows[0] == "ten" and not follows[2] and n < 10 else str(v)) + str(n)
        elif isinstance(v, int) and v % (10 if kind == "small" and n < 10 else 100) == 0:
            self.value = v + n
        else:
            self.value = f"{v}{n}"

    def multiply(self, n: int) -> None:
        v = self.value
        if v is None:
            self.value = n
        elif isinstance(v, int) and v:
            self.value = v // 1000 * 1000 + v % 1000 * n
        else:
            product = Fraction(str(v)) * n if PLAIN.fullmatch(str(v)) else None
            if product is not None and product.denominator == 1:
                self.value = product.numerator
            else:
                self.close()
                self.value = n


def digits_of(words: list[str]) -> list[str]:
    s, at = Number(), 0
    while at < len(words):
        w, before = words[at], words[at - 1] if at else None
        figures, entry = w[-1].isdecimal() and FIGURES.match(w), WORDS.get(w)
        # what most words don't need
        after = words[at + 1] if w in LOOK_AHEAD and at + 1 < len(words) else None
        goes_on = after is not None and (after in WORDS or after in OTHERS or PLAIN.fullmatch(after) is not None)
        if figures:
            if isinstance(s.value, str) and s.value.endswith("."):
                s.value += w
            else:
                s.close()
                s.sign = w[0] if not w[0].isdigit() else s.sign
                s.value = figures[1] if "." in figures[1] else int(figures[1])
        elif entry:
            kind, n, more = entry
            if kind == "zero":
                s.string("0")
            elif kind == "scale":
                s.multiply(n)
            else:
                s.add(kind, n, before)
            if more:
                s.close(more)
        elif w in SIGNS and goes_on:
            s.close()
            s.sign = SIGNS[w]
        elif w in CURRENCIES and s.value is not None:
            s.sign = CURRENCIES[w]
            s.close()
        elif w == "percent" and s.value is not None:
            s.close("%")
        elif w == "per" and s.value is not None and after == "cent":
            s.close("%")
            at += 1
        elif w == "and" and goes_on and WORDS.get(before or "", ("",))[0] == "scale":
            pass
        elif w in REPEATS and goes_on and WORDS.get(after, ("", 0, "x"))[0] in ("small", "zero") and not WORDS[after][2]:
            s.string(str(WORDS[after][1]) * REPEATS[w])
            at += 1
        elif w == "point" and goes_on and (PLAIN.fullmatch(after) or WORDS.get(after, ("",))[0] in ("small", "ten", "zero") and not WORDS[after][2]):
            s.string(".")
        else:
            s.word(w)
        at += 1
    s.close()
    return s.out


def in_digits(text: str) -> str:
    """``text`` (lower case) with its spoken numbers, sums of money, ordinals and percentages in digits."""
    if not ANY.search(text):
        return " ".join(text.split())
    # halves, letters beside digits, endings beside digits
    parts = re.split(r"\band\s+a\s+half\b", text) if "half" in text else [text]
    for i, part in enumerate(parts[:-1]):
        last = part.split()[-1:]
        # behind nothing it is left out, as published
        parts[i] += " point five" if last and WORDS.get(last[0], ("", 0, "x"))[2] == "" else " and a half" if last else ""
    text = " ".join(parts)
    if DIGIT.search(text):
        text = re.sub(r"([a-z])([0-9])", r"\1 \2", text)
        text = re.sub(r"([0-9])([a-z])", r"\1 \2", text)
        text = re.sub(r"([0-9])\s+(st|nd|rd|th|s)\b", r"\1\2", text)
    text = " ".join(digits_of(text.split()))
    if "¢" in text:
        text = re.sub(r"([€£$])([0-9]+) (?:and )?¢([0-9]{1,2})\b", lambda m: f"{m[1]}{m[2]}.{int(m[3]):02d}", text)
    if "0." in text:
        text = re.sub(r"[€£$]0\.([0-9]{1,2})\b", lambda m: f"¢{int(m[1])}", text)
    return re.sub(r"\b1(s?)\b", r"one\1", text)


@F.arrow_udf(StringType())
def standard_numbers(texts: pa.Array) -> pa.Array:
    """``in_digits`` of texts; null stays null."""
    return pa.array([None if t is None else in_digits(t) for t in texts.to_pylist()], pa.string())


def spelled(n: Column) -> Column:
    """A whole number from 0 to below 10**15 in words."""
    small, tens = F.array(*(F.lit(w) for w in SMALL)), F.array(*(F.lit(w) for w in TENS))
    part = lambda x, by: F.call_function("div", x, F.lit(by))

    def below_thousand(g: Column) -> Column:
        hundred, rest = part(g, 100), g % 100
        of = lambda words, i: F.try_element_at(words, i.cast("int"))
        return F.concat_ws(" ", F.when(hundred > 0, F.concat(of(small, hundred), F.lit(" hundred"))), F.when(rest >= 20, of(tens, part(rest, 10) - 1)),
                           F.when((rest > 0) & (rest < 20), of(small, rest)).when(rest % 10 > 0, of(small, rest % 10)))

    groups = [(k, part(n, 1000**k) % 1000) for k in range(4, -1, -1)]
    said = [F.when(g > 0, F.concat(below_thousand(g), F.lit(f" {SCALES[k - 1]}" if k else ""))) for k, g in groups]
    return F.when(n == 0, "zero").otherwise(F.concat_ws(" ", *said))
