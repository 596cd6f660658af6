"""Text functions as column expressions; Unicode normal forms, which Spark lacks, as Arrow functions over whole columns."""

from __future__ import annotations

import re
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: The marks that end a sentence.
MARKS = ".!?。！？"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_mark(text: Column | str) -> Column:
    """The text holds a sentence mark."""
    return col(text).rlike(f"[{MARKS}]")


def only_marks(text: Column | str) -> Column:
    """Trimmed and not empty, every character is Unicode punctuation."""
    return F.coalesce(F.trim(col(text)).rlike(r"^\p{P}+$"), F.lit(False))


#: Marks, symbols and punctuation; most characters are ASCII letters, which are told first.
SYMBOLS = r"[\P{Alnum}&&[\p{M}\p{S}\p{P}]]"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s))


def normalize_text(text: Column | str, unicode: bool = True) -> Column:
    """lower case, NFC, everything but letters, digits, _, - and ' becomes a space; spaces collapse, ends are trimmed. `unicode`
    False leaves NFC out and stays in the JVM: right for texts that are composed already."""
    low = F.lower(col(text))
    low = nfc(low) if unicode else low
    # white space is among what becomes a space, so runs of it all do at once; one space before a letter stays as it is
    return F.trim(F.regexp_replace(low, r"(?! \p{Alnum})[\P{Alnum}&&[^\p{L}\p{N}_\-']]+", " "))


def remove_symbols(text: Column | str) -> Column:
    """NFKC; marks, symbols and punctuation become spaces."""
    return F.regexp_replace(nfkc(col(text)), SYMBOLS, " ")


#: Letters that do not decompose, with their plain spelling.
PLAIN_LETTERS = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}


def remove_symbols_and_diacritics(text: Column | str, keep: str = "") -> Column:
    """NFKD without diacritics, plain spelling of special letters; marks, symbols and punctuation but `keep` become spaces."""
    out = F.regexp_replace(nfkd(col(text)), r"\p{Mn}", "")
    for letter, plain in PLAIN_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    saved = "".join("\\" + c if c in "\\]^-[&" else c for c in keep)
    return F.regexp_replace(out, rf"[\P{{Alnum}}&&[\p{{M}}\p{{S}}\p{{P}}]&&[^{saved}]]" if keep else SYMBOLS, " ")


def without_asides(text: Column) -> Column:
    """Without words in angle or square brackets, then without words in parentheses."""
    return F.regexp_replace(F.regexp_replace(text, r"[<\[][^>\]]*[>\]]", ""), r"\(([^)]+?)\)", "")


def basic_normalize(text: Column | str, remove_diacritics: bool = False, split_letters: bool = False) -> Column:
    """lower case, no asides, F2 or F3, optionally one space between graphemes; spaces collapse, ends are not trimmed."""
    out = without_asides(F.lower(col(text)))
    out = F.lower(remove_symbols_and_diacritics(out) if remove_diacritics else remove_symbols(out))
    if split_letters:
        out = F.array_join(F.regexp_extract_all(out, F.lit(r"\X"), F.lit(0)), " ")
    return F.regexp_replace(out, r"(?U)\s+", " ")


def extract_number(label: Column | str) -> Column:
    """the first whole number in a label, or 0."""
    return F.coalesce(F.regexp_extract(col(label), "([0-9]+)", 1).try_cast("int"), F.lit(0))


def words(text: Column | str) -> Column:
    """lower-case words of letters and digits, with inner apostrophes."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"), F.lit(0))


def without_replacement_chars(text: Column | str) -> Column:
    """without U+FFFD; null where nothing remains."""
    out = F.replace(col(text), F.lit("�"), F.lit(""))
    return F.when(F.length(out) > 0, out)


def escape_arrow(text: Column | str) -> Column:
    """the cue arrow becomes ->, tabs become spaces."""
    return F.replace(F.replace(F.trim(col(text)), F.lit("-->"), F.lit("->")), F.lit("\t"), F.lit(" "))


def highlight(words_col: Column | str, i: Column) -> Column:
    """the words joined, the i-th (from 0) underlined behind its leading space."""
    return F.array_join(F.transform(col(words_col), lambda w, j: F.when(j == i, F.regexp_replace(w, r"^(\s*)(.*)$", "$1<u>$2</u>")).otherwise(w)), "")


def strip_committed_prefix(buffer: Column, new_text: Column) -> Column:
    """P20: a buffer that begins with the text just committed loses it and the space after it."""
    return F.when((F.length(new_text) > 0) & F.startswith(buffer, new_text), F.ltrim(F.substr(buffer, F.length(new_text) + 1))).otherwise(buffer)


def common_prefix_length(a: Column, b: Column) -> Column:
    """how many leading items of two arrays are equal."""
    same = F.slice(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), 1, F.least(F.size(a), F.size(b)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def _wide_class() -> str:
    """The East Asian wide and fullwidth characters as ranges of a character class, from Python's Unicode data."""
    out, start = [], None
    for c in range(0x1100, 0x30000):
        wide = unicodedata.east_asian_width(chr(c)) in "WF"
        if wide and start is None:
            start = c
        if not wide and start is not None:
            out.append(rf"\x{{{start:x}}}-\x{{{c - 1:x}}}")
            start = None
    return "".join(out)


WIDE = _wide_class()


def join_fragments(fragments: Column) -> Column:
    """fragments joined; a space only between two letters or digits that are not East Asian wide."""
    narrow = rf"(?U)^[\p{{Alnum}}&&[^{WIDE}]]$"
    said = F.filter(fragments, lambda f: f != "")
    before = F.concat(F.array(F.lit("")), said)  # each fragment's predecessor, and one more
    spaced = lambda p, f: F.when(F.right(p, F.lit(1)).rlike(narrow) & F.left(f, F.lit(1)).rlike(narrow), F.concat(F.lit(" "), f)).otherwise(F.coalesce(f, F.lit("")))
    return F.array_join(F.zip_with(before, said, spaced), "")


@F.pandas_udf(DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """UTF-8 bytes over zlib bytes."""
    def ratio(s: str | None) -> float | None:
        data = None if s is None else s.encode()
        return None if data is None else len(data) / len(zlib.compress(data))

    return text.map(ratio)


def repetition_loop(ws: Column) -> Column:
    """at least 12 words and a single word 8 times running, or the tail an n-gram (2 to 8) at least 3 times over at least
    12 words, or an n-gram that comes at least 4 times over at least 12 words and 55 % of all."""
    n = F.size(ws)
    runs = F.exists(F.sequence(F.lit(1), F.greatest(n - 7, F.lit(1))), lambda i: F.forall(F.slice(ws, i, 8), lambda w: w == F.element_at(ws, i)))

    def tail(k: int) -> Column:
        need = max(3, -(-12 // k))
        part = lambda r: F.slice(ws, n - k * (r + 1) + 1, k)
        return (n >= k * need) & F.forall(F.sequence(F.lit(1), F.lit(need - 1)), lambda r: part(r) == part(F.lit(0)))

    def often(k: int) -> Column:
        grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, k), " ")))
        start = F.struct(F.lit("").alias("g"), F.lit(0).alias("c"), F.lit(0).alias("m"))
        step = lambda a, g: F.struct(g.alias("g"), F.when(a["g"] == g, a["c"] + 1).otherwise(1).alias("c"), F.greatest(a["m"], F.when(a["g"] == g, a["c"] + 1).otherwise(1)).alias("m"))
        top = F.aggregate(grams, start, step, lambda a: a["m"])
        return (top >= 4) & (top * k >= 12) & (top * k >= 0.55 * n)

    sizes = range(2, 9)
    any_of = lambda f: F.coalesce(sum((F.when(F.floor(n / 2) >= k, f(k)).otherwise(False).cast("int") for k in sizes), F.lit(0)) > 0, F.lit(False))
    return F.when(n < 12, False).otherwise(((n >= 8) & runs) | any_of(tail) | any_of(often))


#: Spoken fillers, and contractions and titles with their long forms, in the order in which they apply.
FILLERS = r"(?=[hmu])\b(hmm|mm|mhm|mmm|uh|um)\b"
LONG_FORMS = (
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"), (r"\by'all\b", "you all"),
    (r"\bwanna\b", "want to"), (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"), (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"),
    (r"\bwoulda\b", "would have"), (r"\bcoulda\b", "could have"), (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"),
    (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bst\b", "saint "), (r"\bdr\b", "doctor "), (r"\bprof\b", "professor "),
    (r"\bcapt\b", "captain "), (r"\bgov\b", "governor "), (r"\bald\b", "alderman "), (r"\bgen\b", "general "), (r"\bsen\b", "senator "),
    (r"\brep\b", "representative "), (r"\bpres\b", "president "), (r"\brev\b", "reverend "), (r"\bhon\b", "honorable "), (r"\basst\b", "assistant "),
    (r"\bassoc\b", "associate "), (r"\blt\b", "lieutenant "), (r"\bcol\b", "colonel "), (r"\bjr\b", "junior "), (r"\bsr\b", "senior "), (r"\besq\b", "esquire "),
    (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"), (r"'s gone\b", " has gone"), (r"'d done\b", " had done"), (r"'s got\b", " has got"),
    (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"), (r"'t\b", " not"), (r"'ve\b", " have"), (r"'m\b", " am"),
)


def long_forms(text: Column) -> Column:
    """Contractions and titles with their long forms, one after the other; a pattern is tried only on texts that hold its letters, and looks up the boundary before a word behind it."""
    letters = {p: p.replace(r"\b", "") for p, _ in LONG_FORMS}
    tried = lambda p: rf"{letters[p]}(?<={p[:2]}{letters[p]})\b" if p.startswith(r"\b") else p
    forms = F.array(*(F.struct(F.lit(letters[p]).alias("letters"), F.lit(tried(p)).alias("pattern"), F.lit(long).alias("long")) for p, long in LONG_FORMS))
    return F.aggregate(forms, text, lambda t, f: F.when(F.contains(t, f["letters"]), F.regexp_replace(t, f["pattern"], f["long"])).otherwise(t))


def english_normalize(text: Column | str, numbers: bool = True) -> Column:
    """lower case, no asides or fillers, long forms, symbols away but those around numbers, spoken numbers as digits. The spelling
    table of the reference is not public data here; J11 (`lookup`) applies a user's."""
    from talkframe.functions.numbers import spoken_numbers

    out = F.regexp_replace(without_asides(F.lower(col(text))), FILLERS, "")
    out = long_forms(F.regexp_replace(out, r"\s+'", "'"))
    out = F.regexp_replace(out, r"(\d),(\d)", "$1$2")
    out = F.regexp_replace(out, r"\.([^0-9]|$)", " $1")
    out = remove_symbols_and_diacritics(out, keep=".%$¢€£")
    out = spoken_numbers(out) if numbers else out
    out = F.regexp_replace(out, r"[.$¢€£]([^0-9])", " $1")
    out = F.regexp_replace(out, r"([^0-9])%", "$1 ")
    return F.regexp_replace(out, r"\s+", " ")


LANGUAGE_TAG = re.compile(r"<\|([a-z]{2,3}(?:-[a-z]+)?)\|>")


def language_tag(text: Column | str) -> Column:
    """the language that a control tag names, null without one."""
    found = F.regexp_extract(col(text), LANGUAGE_TAG.pattern, 1)
    return F.when(found != "", found)


def without_tags(text: Column | str) -> Column:
    """the text without control tags."""
    return F.trim(F.regexp_replace(col(text), r"<\|[^|]*\|>", ""))
