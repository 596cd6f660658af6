"""spoken English numbers as digits. Sequential within a text, so an Arrow function over the column; rows are independent."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The number words, their irregular endings, and the words and signs around numbers.
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split()
ZEROS = "o oh zero".split()
ORDINALS = {"first": (1, "st"), "second": (2, "nd"), "third": (3, "rd"), "fifth": (5, "th"), "twelfth": (12, "th"), "zeroth": (0, "th")}
BEFORE = {"minus": "-", "negative": "-", "plus": "+", "positive": "+"}
AFTER = {"dollar": "$", "dollars": "$", "pound": "£", "pounds": "£", "euro": "€", "euros": "€", "cent": "¢", "cents": "¢"}
REPEAT = {"double": 2, "triple": 3}
SIGNS = "-+$£€¢"


def _lexicon() -> dict[str, tuple[str, int, str]]:
    """Every number word: what it is (unit, ten or scale), its value, and the ending that closes the number."""
    plain = {w: ("unit", n) for n, w in enumerate(ONES, 1)} | {w: ("ten", 10 * n) for n, w in enumerate(TENS, 2)}
    plain |= {"hundred": ("scale", 100)} | {w: ("scale", 1000**n) for n, w in enumerate(SCALES, 1)}
    words = {w: (*v, "") for w, v in plain.items()} | {w: ("unit", *v) for w, v in ORDINALS.items()}
    irregular = {n for n, _ in ORDINALS.values()}
    for w, (kind, n) in plain.items():
        stem = w[:-1] + "i" if kind == "ten" else w
        words["sixes" if w == "six" else stem + ("es" if kind == "ten" else "s")] = (kind, n, "s")
        if kind != "unit" or n not in irregular:
            words[stem + ("eth" if kind == "ten" else "h" if w.endswith("t") and kind == "unit" else "th")] = (kind, n, "th")
    return words | {w: ("zero", 0, "") for w in ZEROS}


LEXICON = _lexicon()
KNOWN = {*LEXICON, *BEFORE, *AFTER, *REPEAT, "per", "percent", "and", "point"}
PLAIN = {w: v for w, v in LEXICON.items() if not v[2]}
FIGURES = re.compile(r"\d+(\.\d+)?")
HALF = re.compile(r"\band\s+a\s+half\b")
BORDER = re.compile(r"[0-9]+")
ENDING = re.compile(r"([0-9])\s+(?=(?:st|nd|rd|th|s)\b)")
CENTS = re.compile(r"([€£$])([0-9]+) (?:and )?¢([0-9]{1,2})\b")
ONLY_CENTS = re.compile(r"[€£$]0.([0-9]{1,2})\b")
LONE_ONE = re.compile(r"\b1(s?)\b")


def kind_of(word: str | None) -> str:
    return PLAIN[word][0] if word in PLAIN else ""


class Number:
    """A number as it is spoken: `held` is an amount (int) while its words add up, and a row of figures (str) once they are read out one by
    one; `sign` waits for the next thing that is said."""

    def __init__(self) -> None:
        self.held: int | str | None = None
        self.sign = ""

    def say(self, what: str) -> str:
        what, self.sign, self.held = self.sign + what, "", None
        return what

    def flush(self) -> Iterator[str]:
        if self.held is not None:
            yield self.say(str(self.held))

    def row(self, figures: str) -> None:
        """Figures behind what is held; an amount of nothing leaves no figure."""
        self.held = f"{self.held or ''}{figures}"

    def below_hundred(self, kind: str, n: int, before: str | None) -> None:
        """A unit or ten: it fills the empty places of an amount, or follows as figures. A unit after a ten in a row of figures takes its zero's place; two units
        running are figures."""
        room = 10 if n < 10 else 100
        if self.held is None:
            self.held = n
        elif isinstance(self.held, str) and kind == "unit" and n < 10 and kind_of(before) == "ten":
            self.held = self.held[:-1] + str(n)
        elif isinstance(self.held, str) or (kind == "unit" and kind_of(before) == "unit") or self.held % room:
            self.held = f"{self.held}{n}"
        else:
            self.held += n

    def scale(self, by: int) -> Iterator[str]:
        """Hundred, thousand and so on: of an amount the last three places are multiplied, of figures the whole, if that is whole."""
        if self.held is None:
            self.held = by
        elif isinstance(self.held, int):
            self.held += self.held % 1000 * (by - 1)
        else:
            try:
                product = Fraction(self.held) * by
            except ValueError:  # a lone point
                product = None
            if product is None or product.denominator > 1:
                yield from self.flush()
                self.held = by
            else:
                self.held = product.numerator

    def figures(self, word: str) -> Iterator[str]:
        """Arabic figures, maybe with a sign: they go on behind a point, else they are a number of their own."""
        if isinstance(self.held, str) and self.held.endswith("."):
            self.held += word
            return
        yield from self.flush()
        self.sign = word[0] if word[0] in SIGNS else self.sign
        word = word.lstrip(SIGNS)
        self.held = int(Fraction(word)) if Fraction(word).denominator == 1 else word


def read(words: list[str]) -> Iterator[str]:
    """The words of a text with numbers put together."""
    number = Number()
    skip = False
    for before, word, after in zip([None, *words], words, [*words[1:], None], strict=False):
        if skip:
            skip = False
            continue
        figures_next = bool(after and FIGURES.fullmatch(after))
        goes_on = after in KNOWN or figures_next
        if FIGURES.fullmatch(word[1:] if word[0] in SIGNS else word):
            yield from number.figures(word)
        elif word in LEXICON:
            kind, n, ending = LEXICON[word]
            if kind == "zero":
                number.row("0")
            elif kind == "scale":
                yield from number.scale(n)
            else:
                number.below_hundred(kind, n, before)
            if ending:
                yield number.say(f"{number.held}{ending}")
        elif word in BEFORE and goes_on:
            yield from number.flush()
            number.sign = BEFORE[word]
        elif word in AFTER and number.held is not None:
            number.sign = AFTER[word]
            yield from number.flush()
        elif number.held is not None and (word == "percent" or word == "per" and after == "cent"):
            yield number.say(f"{number.held}%")
            skip = word == "per"
        elif word == "and" and goes_on and kind_of(before) == "scale":
            pass
        elif word in REPEAT and (kind_of(after) == "unit" or after in ZEROS):
            number.row(str(PLAIN[after][1]) * REPEAT[word])
            skip = True
        elif word == "point" and goes_on:
            if figures_next or kind_of(after) in ("unit", "ten", "zero"):
                number.row(".")
        else:
            yield from number.flush()
            yield number.say(word)
    yield from number.flush()


def parted(m: re.Match) -> str:
    """Figures with a space where they touch a letter from a to z."""
    before, after = m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
    return (" " if "a" <= before <= "z" else "") + m[0] + (" " if "a" <= after <= "z" else "")


def read_all(words: list[str]) -> Iterator[str]:
    """`read` of a whole text: words that cannot belong to a number are passed on, the reader gets the stretches between them, each with the word that closes it."""
    done = 0
    for i, word in enumerate(words):
        if i >= done and (word in KNOWN or word[0] in SIGNS or word[0].isdecimal()):
            yield from words[done:i]
            done = i + 1
            while done < len(words) and (words[done] in KNOWN or words[done][0] in SIGNS or words[done][0].isdecimal()):
                done += 1
            done += 1
            yield from read(words[i:done])
    yield from words[done:]


def digits(text: str) -> str:
    """A text with its spoken numbers as figures: scales, ordinals and plurals, decimals after "point", signs, currencies with cents, percent, double and
    triple, "and a half"; letters and figures part. A lone 1 is written out."""
    parts = HALF.split(text) if "half" in text else [text]
    told = []
    for i, part in enumerate(parts):
        if part.strip():
            told.append(part)
            if i < len(parts) - 1:
                told.append("point five" if part.split()[-1] in PLAIN else "and a half")
    figures = " ".join(read_all(ENDING.sub(r"\1", BORDER.sub(parted, " ".join(told))).split()))
    if "€" in figures or "£" in figures or "$" in figures:
        figures = CENTS.sub(lambda m: f"{m[1]}{m[2]}.{int(m[3]):02}", figures)
        figures = ONLY_CENTS.sub(lambda m: f"¢{int(m[1])}", figures)
    return LONE_ONE.sub(r"one\1", figures) if "1" in figures else figures


@F.pandas_udf(StringType())
def spoken_numbers(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else digits(s))
