"""op8: a lead that very many different contexts share is split over tasks, with the same result."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from talkframe.llm import suffix_dedup


def repeats_brute(rows, length=100):
    seen, out = set(), {}
    for i, b in sorted({(i, t.encode()) for i, t in rows}):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_crowded_leads(spark, monkeypatch):
    random.seed(8)
    say = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    short, long = say(60), say(130)
    rows = [(i, say(150) + short + say(150)) for i in range(40)] + [(40 + i, say(90) + long + say(90)) for i in range(40)]
    rows += [(80, say(50) + long + say(40) + long + say(90)), (-5, long), (81, "x" * 400)]
    rows += [rows[3], rows[50]]  # a document that is in the table twice is no repeat of itself
    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    most, plain = [], suffix_dedup.partial_repeats

    def spied(contexts, length):
        most.extend(r.n for r in contexts.groupBy("lead", "tail").agg(F.count_distinct("key", "h", "p1").alias("n")).collect())
        return plain(contexts, length)

    monkeypatch.setattr(suffix_dedup, "partial_repeats", spied)
    got = collections.Counter(map(tuple, suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()))
    want = repeats_brute(rows)
    assert got == collections.Counter((i, *want[i]) for i, _ in rows)
    assert max(most, default=0) <= 3 and sum(w[1] for w in want.values()) > 0
