"""Functions for SQL users: registered by name in a session."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from talkframe.functions import text


@udtf(returnType="i int, word string, start_s double, end_s double")
class WordsOf:
    """words_of(text, start, end): the words with equal shares of the time."""

    def eval(self, said: str, start: float, end: float):
        found = re.findall(r"\s*\S+", said or "")
        share = (end - start) / len(found) if found else 0.0
        for i, word in enumerate(found):
            yield i, word, start + i * share, end if i == len(found) - 1 else start + (i + 1) * share


def register(spark: SparkSession) -> None:
    """words_of as a table function; nfc, nfkc, nfkd and compression_ratio as functions."""
    spark.udtf.register("words_of", WordsOf)
    for name in ("nfc", "nfkc", "nfkd", "compression_ratio"):
        spark.udf.register(name, getattr(text, name))


def decoration(text: str) -> bool:
    """Only white space, marks, punctuation, symbols and joiners."""
    return all(c.isspace() or c == "\u200d" or unicodedata.category(c)[0] in "MPSZ" for c in text)


def project_words(words: list[str], clean: str) -> list[str] | None:
    """the pieces of `clean` that the words stand for, in order; together they are `clean`. Decoration between two words stays with the first, but for the
    white space right before the second. Null if a word is empty or missing, or if text between words is no decoration."""
    begins, ends = [], [0]
    for word in words:
        begin = clean.find(word, ends[-1]) if word else -1
        if begin < 0 or not decoration(clean[ends[-1] : begin]):
            return None
        begins.append(begin)
        ends.append(begin + len(word))
    if not decoration(clean[ends[-1] :]):
        return None
    cuts = [0, *(end + len(clean[end:begin].rstrip()) for end, begin in zip(ends[1:], begins[1:], strict=False)), len(clean)]
    return [clean[x:y] for x, y in zip(cuts, cuts[1:], strict=False)] if words else []


def tagged_tokens(df, text_col: str = "text", words_col: str = "words"):
    """df with lang (from the control tag), clean text, tokens (the words as the clean text writes them) and error_code, null for good rows."""
    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(StringType()))
    def projected(ws, cs):
        import pandas as pd

        return pd.Series([None if w is None or c is None else project_words(list(w), c) for w, c in zip(ws, cs, strict=True)])

    out = df.withColumns({"lang": text.language_tag(text_col), "clean": text.without_tags(text_col)}).withColumn("tokens", projected(words_col, "clean"))
    return out.withColumn("error_code", F.when(F.col("tokens").isNull(), "projection"))
