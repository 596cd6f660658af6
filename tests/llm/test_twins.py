"""Operators that SQL cannot express against plain twins: naive Bayes, attention scoring, shard order, odd sketches; the pipeline's stages on awkward rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from talkframe.llm import language_id, near_dedup, quality, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, slot int"


def grams(text):
    """Buckets of all 1- to 3-grams, one character at a time."""
    codes = [ord(c) for c in text.lower()] + [32, 32]
    for i in range(len(codes) - 2):
        key = 0
        for k in range(3):
            key = (key + codes[i + k] + k + 1) * 0x9E3779B97F4A7C15 % 2**64
            key ^= key >> 29
            yield (key >> 40) % language_id.BUCKETS


def test_naive_bayes(spark):
    rng = random.Random(8)
    kinds = {"aa": "der die das und ßig ühn", "bb": "the and of thou shin", "cc": "el la ñu os ca"}
    rows = [(i, " ".join(rng.choices(kinds[k].split() + ["x", "7"], k=rng.randrange(1, 30))), k) for i in range(90) for k in [rng.choice(list(kinds))]]
    rows += [(200, "", "aa"), (201, None, "bb"), (202, "Zoë ΣΑΣ", None), (203, "!!", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(4)
    train, counts, docs = [r for r in rows if r[2] and r[0] % 3], collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in train:
        counts[lang].update(grams(text or ""))
        docs[lang] += 1
    want = {}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            want[i] = ("und", 0.0)
            continue
        joint = {k: math.log(docs[k] / len(train)) + sum(math.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * language_id.BUCKETS)) for g in grams(text)) for k in sorted(docs)}
        best = max(joint, key=joint.get)
        want[i] = (best, 1 / sum(math.exp(v - joint[best]) for v in joint.values()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, language_id.fit(df.where("doc_id % 3 <> 0"))).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-4) for i in want)


def test_attention_scores():
    rng = np.random.default_rng(4)
    shape = {"W": (quality.N_FEATURES, 5), "b": (5,), "V": (5, 3), "U": (5, 3), "w": (3,), "c": (5,), "d": (1,)}
    p = {k: rng.normal(0, 1, s) for k, s in shape.items()}
    model = quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), p)
    for text in ("", "a", "Some words, 12 of them!\n" * 90, "é" * 5000, "x y " * 300_000):
        data = text.encode()
        passages = [data[i : i + quality.PASSAGE] for i in range(0, len(data), quality.PASSAGE)] or [b""]
        hidden, energy = [], []
        for k, part in enumerate(passages):
            f = np.zeros(quality.N_FEATURES)
            for b in part:
                f[quality.FINE[b]] += 1
            for a, b in zip(part, part[1:]):
                f[quality.N_FINE + quality.COARSE[a] * quality.N_COARSE + quality.COARSE[b]] += 1
            if k and len(data) and (k * quality.PASSAGE) % quality.PIECE:  # a pair over the border counts with the later passage
                f[quality.N_FINE + quality.COARSE[passages[k - 1][-1]] * quality.N_COARSE + quality.COARSE[part[0]]] += 1
            f /= max(len(part), 1)
            words = part.lower().split()
            f[-2] = len(set(words)) / len(words) if words else 1.0
            f[-1] = math.log1p(max(len(part), 1))
            h = np.tanh(np.sqrt(f) @ p["W"] + p["b"])
            hidden.append(h)
            energy.append(np.tanh(h @ p["V"]) * (1 / (1 + np.exp(-(h @ p["U"])))) @ p["w"])
        a = np.exp(np.array(energy) - max(energy))
        bag = (a[:, None] * np.array(hidden)).sum(0) / a.sum()
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-(bag @ p["c"] + p["d"][0]))), abs=1e-4)


def test_shard_order(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("a bb ccc dddd".split(), k=rng.randrange(60))) for _ in range(60)]
    rows = [(i if i % 40 else None, rng.choice([*texts, None, "same"]), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s30", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    data = [(i, (t or "").encode(), s, g) for i, t, g, s in rows]
    first = {}
    for i, b, s, g in sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        first.setdefault(b, (s, g))
    number = lambda v, skip: -1 if v is None else int.from_bytes(v.encode()[skip : skip + 7].ljust(7, b"\0"), "big")
    points = [(number(first[b][0], 1), number(first[b][1], 0), len(b) + 16) for _, b, _, _ in data]
    at = lambda values, q: sorted(values)[max(math.ceil(q / 16 * len(values)), 1) - 1]
    cuts = [[at([p[d] for p in points], q) for q in range(1, 16)] for d in range(3)]
    curve = sharding.curve_table()
    cell = lambda p: curve[sum(sum(p[d] > c for c in cuts[d]) * 16 ** (2 - d) for d in range(3))]
    order = sorted((cell(p), zlib.crc32(b), len(b) + 16, i is not None, i or 0) for p, (i, b, _, _) in zip(points, data))
    n = len(order)
    want = collections.Counter((o[4] if o[3] else None, o[1], r * 7 // n, r - -(-(r * 7 // n) * n // 7), o[0]) for r, o in enumerate(order))
    got = collections.Counter((r.doc_id, r.text_crc32, r.shard, r.slot, r.curve) for r in sharding.shard(df, 7).collect())
    assert got == want


def test_sketches_never_lose_a_link(spark):
    rng = np.random.default_rng(6)
    rows, exact = [], {}
    for k, n in enumerate((1, 5, 100, 256, 257, 900, 5000)):
        for share in (0.0, 0.05, 0.1, 0.11, 0.2, 0.5):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * (1 - share)) or 1], rng.integers(0, 1 << 63, int(len(a) * share), np.uint64)]))
            both = [(len(s), near_dedup.folded(o).tolist(), o.tolist() if len(o) > near_dedup.LONGS else None) for s in (a, b) for o in [near_dedup.odd_sketch(s)]]
            rows.append((len(rows), *both))
            met = len(np.intersect1d(a, b))
            exact[rows[-1][0]] = met / (len(a) + len(b) - met)
    kind = "struct<n:bigint,small:array<bigint>,large:array<bigint>>"
    df = spark.createDataFrame(rows, f"k int, x {kind}, y {kind}")
    passed = {r.k for r in df.where(near_dedup.possible("x", "y", 80)).collect()}
    assert {k for k, j in exact.items() if j >= 0.8} <= passed
    assert not {k for k, j in exact.items() if j < 0.6 and rows[k][1][0] >= 100} & passed


def test_near_group_of_many_variants(spark):
    """A large group of near copies, some of which are linked over others only: every link of brute force is found."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 12))):
            words[rng.randrange(80)] = f"v{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, t in rows for w in [t.split()]}
    label = {i: i for i in sets}
    find = lambda x: x if label[x] == x else find(label[x])
    links = 0
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links += 1
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), width=2).collect()}
    assert links > 5000 and got == {i: find(i) for i in sets}


def test_stages_on_awkward_rows(spark, sf):
    import corpus_pipeline as pipeline

    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("text IS NOT NULL").first().text
    clean = "a quiet morning in the old town brought the baker and his three sons to the market square with bread for all"
    rows = [
        (None, item, "en", "s", 1, "x", 7), (None, clean, "en", None, 1, "x", 7), (1, clean, "en", "s", 1, "x", 7), (1, clean, "en", "s", 1, "y", 8), (1, "another text " + item, "en", "s", 1, "x", 7),
        (2, clean + " today", "fr", "s", 1, "x", 7), (3, None, None, None, None, None, None), (4, "", "en", "s", 0, "x", 7), (4, "", "en", "s", 0, "x", 7), (5, "word " * 30_000, "en", "s2", 1, "x", 7),
    ]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit("clash") for c in ("_id", "_h", "h", "key", "row", "n", "kept", "_salt", "_band", "rank", "a.b")})
    good = pipeline.good_quality(spark, docs, sf)
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), language_id.fold(5) != 0)
    score = (lambda t: model.score(t or "")) if model else (lambda t: 1.0)
    assert sorted(map(str, good.collect())) == sorted(str(r) for r in docs.collect() if score(r.text) >= 0.3) and good.columns == docs.columns
    one = collections.Counter((r.doc_id, r.text) for r in pipeline.one_of_each_group(spark, docs, sf).collect())
    # rows alike are one, the near copy 2 goes with 1; null ids, texts without words and the other text of id 1 stay
    assert one == collections.Counter({(None, item): 1, (None, clean): 1, (1, clean): 1, (1, "another text " + item): 1, (3, None): 1, (4, ""): 2, (5, "word " * 30_000): 1})
    left = collections.Counter((r.doc_id, r.text) for r in pipeline.uncontaminated(spark, docs, sf).collect())
    assert left == collections.Counter((r[0], r[1]) for r in rows if item not in (r[1] or ""))
    mixed = pipeline.mixed(spark, docs, sf)
    taken = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    there = collections.Counter((r[0], r[1]) for r in rows)
    assert mixed.columns == docs.columns and set(taken) <= set(there) and all(taken[k] <= 2 * there[k] for k in taken)
    out = pipeline.sharded(spark, docs, sf)
    assert sorted(out.columns) == sorted(docs.columns) and sorted((r.shard, r.slot) for r in out.collect()) == [(i * 40 // 10, 0) for i in range(10)]
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
