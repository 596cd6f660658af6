"""Vector codes, divergence audit and SimHash groups against brute force on small, awkward tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from talkframe.llm import divergence, simhash, vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, id string, v int"
DOCS = "doc_id bigint, text string, lang string, source string, fp string, label string, term string"


def vectors(n=400, dims=32):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (n, dims)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + rng.normal(0, 0.004, (n - n // 2, dims)).astype(np.float32)
    x[9] = x[7]  # ties
    rows = [(int(i * 7 % n), [float(c) for c in x[i]], None if i % 11 == 0 else int(i % 3), "c", "x", 1) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1, "", "", 0), (9001, None, 1, "", "", 0), (9002, [None] * dims, 1, "", "", 0)]
    rows += [(9003, [math.nan] + [0.0] * (dims - 1), 0, "", "", 0), (9004, [math.inf] * dims, 0, "", "", 0), (9005, [-0.0] * (dims - 3), 0, "", "", 0), (-1, [], 5, "", "", 0)]
    return rows


def plain_codes(rows, dims, entries=64, rounds=2, parts=16):
    kept = [(r[0], r[2], [math.floor(256 * c) for c in r[1]] + [0] * (dims - len(r[1]))) for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    w = dims // parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for *_, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min(range(len(first)), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = collections.defaultdict(list)
            for *_, v in kept:
                of[nearest(v, p)].append(part(v, p))
            new.append([[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if of[e] else books[p][e] for e in range(len(first))])
        books = new
    out = []
    for i, label, v in kept:
        code = [nearest(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for c in code), sum(far(part(v, p), books[p][c]) for p, c in enumerate(code))))
    total = collections.Counter()
    for _, label, _, error in out:
        total[label] += error
    text = ",".join(str(c) for b in books for e in b for c in e)
    return collections.Counter((i, code, error, total[label]) for i, label, code, error in out), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n", [400, 20])
def test_vector_codes(spark, n):
    rows = vectors(n)
    want, books = plain_codes(rows, 32)
    for parts in (1, 7):
        found, made = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(parts))
        assert collections.Counter(map(tuple, found.collect())) == want and vector_codes.digest(made) == books


def test_vector_codes_of_nothing_and_of_odd_lengths(spark):
    empty, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and books.size == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "", "", 0)], VECTORS))[0].count() == 0
    rows = [(i, [math.sin(i * k) for k in range(1, 20)], i % 2, "", "", 0) for i in range(30)]  # 19 components, filled up to 32
    found, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS.replace("float", "double")))
    want, digest = plain_codes(rows, 32)
    assert collections.Counter(map(tuple, found.collect())) == want and vector_codes.digest(books) == digest
    large = spark.createDataFrame([(1, [3e38] * 16, 0, "", "", 0), (2, [-3e38] * 16, 0, "", "", 0)], VECTORS)
    assert [(r.error, r.label_error) for r in vector_codes.compress(large)[0].collect()] == [(0, 0)] * 2


def test_shortlists_lose_no_entry():
    rng = np.random.default_rng(3)
    for n, spread in ((1, 5), (37, 40), (3000, 9), (3000, 300)):
        x = rng.integers(-spread, spread, (n, 4))
        book = x[rng.integers(0, n, 64)]
        order, low, high, sums = vector_codes.blocks(x)
        rows, short = x[order], vector_codes.shortlists(low, high, book)
        want = ((rows[:, None] - book) ** 2).sum(2).argmin(1)
        assert (vector_codes.nearest(rows, short, book) == want).all()
        total = np.zeros((64, 5), np.int64)
        np.add.at(total, want, np.column_stack([np.ones(n, np.int64), rows]))
        assert (vector_codes.totals(rows, short, sums, book) == total).all()
    assert short.mean() < 0.8 and sorted(order) == list(range(n))


def test_hilbert_neighbours():
    for dims, side in ((2, 16), (3, 8), (4, 4)):
        cells = np.array(list(itertools.product(range(side), repeat=dims)))
        line = cells[np.argsort(vector_codes.hilbert(cells))]
        assert len(set(vector_codes.hilbert(cells).tolist())) == len(cells) and (np.abs(np.diff(line, axis=0)).sum(1) == 1).all()
    assert len(vector_codes.hilbert(np.zeros((3, 40), np.int64))) == 3


def audit_docs():
    random.seed(5)
    frequent = [f"w{i}x" for i in range(40)] + ["É", "naïve", "日本"]  # digits cut words: w and x
    rows = []
    for i in range(90):
        words = [random.choice(["Alpha", "beta", "gamma", "Delta", "eps", "zeta", "naïve", "日本", *frequent[:3]]) for _ in range(random.randint(0, 40))]
        rows.append((i, " ".join(words), random.choice(["en", "en", "fr"]), random.choice(["s1", "s2", "S3", "é", None]), "", "", ""))
    rows += [(100, None, "en", "empty", "", "", ""), (101, None, "xx", "a", "", "", ""), (102, "", "xx", "b", "", "", ""), (None, None, None, None, None, None, None), rows[4], rows[4]]
    return rows + [(103, "alpha 12 beta-gamma " * 3000, "fr", "long", "", "", ""), (104, "rare " * 50, "de", "only", "", "", "")]


def plain_audit(rows):
    df, total, count, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        df[lang].update(set(w)), total[lang].update(w), count[lang, source].update(w)
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= 10]
        p = lambda c, n, kept=kept: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))
        size = lambda c, kept=kept: sum(c[t] for t in kept)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine, all_ = count[lang, source], total[lang]
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            theirs = count[lang, other]
            pairs.append((-sum(f(p(mine[t], size(mine)), p(theirs[t], size(theirs))) for t in kept), other.encode()))
        terms = [(-f(a, b), t.encode()) for t in kept for a, b in [(p(mine[t], size(mine)), p(all_[t], size(all_)))] if mine[t] and a > b]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out += [(lang, source, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("leaves", "groups", "held"), [(4096, 64, 400_000), (4, 2, 5), (1, 1, 1)])
def test_audit(spark, monkeypatch, leaves, groups, held):
    for name, value in (("LEAVES", leaves), ("GROUPS", groups), ("HELD", held), ("PIECE", 50)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence, "priced", priced_with(leaves))
    rows = audit_docs()
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS).repartition(3)).collect())) == plain_audit(rows)


def priced_with(leaves):
    """`priced` with another segment size, set again where the worker runs it."""
    plain = divergence.priced

    def priced(rows):
        divergence.LEAVES = leaves
        return plain(rows)

    return priced


def test_audit_of_nothing_and_of_large_counts(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    counts = np.array([[10**12, 0, 3], [0, 7, 10**15], [1, 1, 1]])
    forest = divergence.Forest(counts)
    p = divergence.values(forest.counts, counts.sum(1).tolist(), 3)
    plain = lambda c, n: 1 + 10**9 * (int(c) + 2) // (int(n) + 6)
    want = [sum((x - y) ** 2 // (x + y) for x, y in ((plain(counts[0, k], counts[0].sum()), plain(counts[h, k], counts[h].sum())) for k in range(3))) for h in (1, 2)]
    assert forest.prices(0, np.array([1, 2]), p).tolist() == want


def test_equal_subtrees_are_one_node():
    counts = np.zeros((5, 1024), np.int64)
    counts[:, 1000] = 9
    forest = divergence.Forest(counts)
    assert len(set(forest.roots.tolist())) == 1 and max(len(left) for left, _ in forest.levels) <= 3


def simhash_docs():
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(300)]
    base = random.choices(vocabulary, k=400)
    texts = [None, "", " \t\n", "a", "a b", "A  B", "one two three four", "x " * 5000, " ".join(base), " ".join(base).upper(), "é ß 日本 ü ö", "ß " * 4]
    for i in range(150):
        words = list(base)
        for _ in range(random.randint(1, 12)):
            words[random.randrange(400)] = random.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [" ".join(random.choices(vocabulary, k=random.randint(1, 9))) for _ in range(150)]
    rows = [(1000 - i, t, "", "", "clash", "", "") for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8], (None, texts[8], "", "", "", "", ""), (None, "lonely words of no id here at all", "", "", "", "", "")]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(pairs):
    """The smallest id that each (id, fingerprint) reaches over links of at most four bits."""
    fps = sorted({f for _, f in pairs})
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            parent[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return collections.Counter((i, f, least.get(find(f))) for i, f in pairs)


def test_fingerprints_are_sparks_own_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42) == simhash.fingerprint("A b\tc  d")


@pytest.mark.parametrize("branch", [simhash.BRANCH, 3])
def test_simhash(spark, monkeypatch, branch):
    monkeypatch.setattr(simhash, "BRANCH", branch)
    rows = simhash_docs()
    want = plain_groups([(r[0], plain_fingerprint(r[1])) for r in rows])
    got = simhash.near_groups(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert len({c for *_, c in want}) < len(rows) - 100
    assert simhash.near_groups(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_layouts_are_complete(spark, blocks):
    random.seed(blocks)
    fps = [random.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    fps += [f ^ sum(1 << b for b in random.sample(range(64), k)) for f in fps for k in (1, 3, 4, 4, 5)]
    nodes = spark.createDataFrame([(f - (f >> 63 << 64),) for f in dict.fromkeys(fps)], "fp bigint")
    links = [(a % 2**64, b % 2**64) for a, b in simhash.joined(simhash.branches(nodes, blocks, 5), blocks).collect()]
    ids = list(enumerate(sorted(set(fps))))
    want = plain_groups(ids)
    parent = {f: f for _, f in ids}
    for _ in range(9):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    number = {f: i for i, f in ids}
    assert collections.Counter((i, f, number[parent[f]]) for i, f in ids) == want


def test_trie_join_of_a_crowd():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 52, 30, np.uint64)
    keys = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << b) ^ np.uint64(1 << c) for b, c in rng.integers(0, 52, (60, 2)).tolist())]))
    whole = np.array([[0, len(keys)]])
    label = simhash.trie_join(keys, 52, whole, whole)
    want = plain_groups(list(enumerate(keys.tolist())))
    assert collections.Counter((i, k, int(label[i])) for i, k in enumerate(keys.tolist())) == want
