"""F1 to F4, F18 and F30 over whole documents against plain Python, character by character."""

import hashlib
import re
import unicodedata
import zlib

from pyspark.sql import functions as F

from talkframe.functions import numbers
from talkframe.functions import text as T
from talkframe.plans import QUERIES


def blank(s, keep="", drop="", plain=None):
    out = []
    for c in s:
        kind = unicodedata.category(c)
        out.append(c if c in keep else (plain or {}).get(c) if c in (plain or {}) else "" if kind == drop else " " if kind[0] in "MSP" else c)
    return "".join(out)


def forms(s):
    low = unicodedata.normalize("NFC", s.lower())
    f1 = re.sub(r"\s+", " ", "".join(c if unicodedata.category(c)[0] in "LN" or c in "_-'" or c.isspace() else " " for c in low)).strip()
    f2 = blank(unicodedata.normalize("NFKC", s))
    f3 = blank(unicodedata.normalize("NFKD", s), drop="Mn", plain=T.PLAIN_LETTERS)
    f4 = re.sub(r"\(([^)]+?)\)", "", re.sub(r"[<\[][^>\]]*[>\]]", "", s.lower()))
    f4 = re.sub(r"\s+", " ", blank(unicodedata.normalize("NFKD", f4), drop="Mn", plain=T.PLAIN_LETTERS).lower())
    return f1, f2, f3, f4, len(s.encode()) / len(zlib.compress(s.encode()))


def test_normal_forms(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["normal_forms"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, s in texts.items():
        r = got[i]
        if s is None:
            assert r.f1 is None and r.f18 is None
        else:
            *texts_, ratio = forms(s)
            assert [r.f1, r.f2, r.f3, r.f4] == [hashlib.sha256(t.encode()).hexdigest() for t in texts_] and abs(r.f18 - ratio) < 1e-3


def test_odd_characters(spark):
    odd = ["Ĳsselmeer ½ ﬁ №5", "Ångström <b> [noise] (aside) x", "œuvre ß Łódź İ", "a b　c", "été ñ", "☃ 100% $5 — “q”"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string")
    rows = df.select("i", T.normalize_text("s").alias("a"), T.remove_symbols("s").alias("b"), T.remove_symbols_and_diacritics("s").alias("c"), T.basic_normalize("s", True).alias("d")).collect()
    for r in rows:
        assert (r.a, r.b, r.c, r.d) == forms(odd[r.i])[:4]


def test_only_stretches_with_numbers_are_read(monkeypatch):
    """the reader of spoken numbers sees the words of numbers and the word behind each, and what it makes of them is what it made of the whole text."""
    given, whole = [], numbers.read
    monkeypatch.setattr(numbers, "read", lambda words: given.extend(words) or whole(words))
    text = "the cat sat on twenty one mats and minus two dogs paid five dollars a1b 2 nd then left double x"
    assert numbers.digits(text) == "the cat sat on 21 mats and -2 dogs paid $5 a 1 b 2nd then left double x".replace(" 1 ", " one ")
    assert len(given) < len(text.split()) and "cat" not in given and "twenty" in given


def test_long_forms_in_order(spark):
    """long forms are told by their letters first; the results are those of all patterns in turn."""
    odd = ["he's gotta go", "he'd been't", "'tn't", "i'ma'am mr's st first", "won't can't let's", "émr mr dr's", "the cat"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "i int, s string").select("i", T.long_forms(F.col("s")).alias("t")).collect()
    for r in rows:
        t = odd[r.i]
        for pattern, long in T.LONG_FORMS:
            t = re.sub(pattern, long, t)
        assert r.t == t
