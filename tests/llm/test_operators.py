"""Each operator against brute force on a small, awkward table; empty tables; extra columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from talkframe.llm import components, decontamination, exact_dedup, html_text, language_id, mixing, near_dedup, quality, sharding, suffix_dedup, token_counts
from talkframe.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, row string"
WHITE = " \t\n\x0b\x0c\r"


def corpus():
    random.seed(9)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "Nu", "pé", "ß") for b in ("ta", "re", "si", "do", "x")]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    base, passage = say(120), say(40)
    texts = [None, "", " \t\n", "a", "...", "日本語 テキスト", "é" * 40, base, base, base.replace(" ", "\n"), base.upper(), say(6000)]
    for i in range(60):
        words = base.split()
        for _ in range(i // 4):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [say(30) + " " + passage + " " + say(20) for _ in range(8)] + [say(random.randint(1, 60)) for _ in range(40)]
    rows = [(i, t, random.choice(["en", "fr", None]), random.choice(["s1", "s2", "s10", None, "s1"]), 1, "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[7], (None, base, "en", "s1", 1, "", ""), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bytes_of(t):
    return (t or "").encode()


def test_token_counts(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = collections.Counter(map(tuple, token_counts.token_counts(docs, path, 100).collect()))
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == collections.Counter((r[0], len(bytes_of(r[1])), n(r[1]), n(r[1]) > 100) for r in corpus())
    assert token_counts.token_counts(empty, path).count() == 0
    counter, odd = token_counts.Counter(path), ["'ll <|endoftext|> x", "İstanbul ǅ ŉ", "Σας ﬁ ５", "don't''re 12,5%\x85\xa0", "é 힣 ก็"]
    assert counter.counts(odd) == [n(t) for t in odd]


def test_exact_groups(docs, empty):
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(f"[{WHITE}]", "", t or "")
    for r in corpus():
        groups[norm(r[1])].append(((-len(r[1] or ""), r[0] is None, r[0] or 0), r[0]))
    want = []
    for r in corpus():
        g = groups[norm(r[1])]
        keep = min(g)[1]
        want.append((r[0], keep, len(g), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    assert collections.Counter(map(tuple, exact_dedup.exact_groups(docs).collect())) == collections.Counter(want)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_language_id(spark, empty):
    random.seed(1)
    words = {"x1": ["alfa", "beto", "cita"], "x2": ["wurm", "gross", "stein"]}
    rows = [(i, " ".join(random.choices(words[k], k=20)), k, "s", 1, "", "") for i, k in enumerate(["x1", "x2"] * 40)] + [(90, None, "x1", "s", 1, "", ""), (91, "12 !?", "x1", "s", 1, "", ""), (92, "alfa " * 300_000, None, "s", 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(df.where("doc_id < 40"))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:80]) and got[92].lang_pred == "x1"
    assert [(got[i].lang_pred, got[i].score) for i in (90, 91)] == [("und", 0.0)] * 2
    assert language_id.fit(empty) is None and language_id.predict(df, None).where("lang_pred <> 'und'").count() == 0
    text = "abc" * 200_000
    assert sum(len(b) for b in language_id.gram_buckets(text)) == 3 * len(text)


def test_sharding(docs, empty):
    got = sharding.shard(docs, 7).collect()
    rows = corpus()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((r[0] or -1 if r[0] != 0 else 0 or -1, len(bytes_of(r[1])) + 16, zlib.crc32(bytes_of(r[1]))) for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard(empty, 7).count() == 0
    spread = collections.defaultdict(set)
    for r in got:
        spread[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(s) <= 2 and max(s) - min(s) == len(s) - 1 for s in spread.values())  # a run's end may cut a group
    carried = sharding.shard(docs, 7, carry=True)
    assert carried.count() == len(rows) and carried.select("row.*").columns == docs.columns
    table = sharding.curve_table()
    assert sorted(table) == list(range(4096))
    place = {t: (i >> 8, i >> 4 & 15, i & 15) for i, t in enumerate(table)}
    assert all(sum(abs(x - y) for x, y in zip(place[i], place[i + 1], strict=True)) == 1 for i in range(4095))


def test_sharding_of_a_hot_text_and_long_names(spark):
    rows = [(i, "same text" if i % 3 else f"text {i % 900}", f"https://host-{i % 40:02}.example/", "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(5)
    got = sharding.shard(docs, 10, most=1).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append((r.slot, r.text_crc32))
    assert sorted(by) == list(range(10)) and all(sorted(s for s, _ in v) == list(range(600)) for v in by.values())
    line = [c for k in sorted(by) for _, c in sorted(by[k])]
    assert sum(a != b for a, b in zip(line, line[1:])) == len(set(line)) - 1  # equal texts lie side by side
    assert sharding.common_bytes(docs, ("source", "lang")) == [13, 2]


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((r[0], size(r[1])) for r in corpus())
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    groups = {(r.source_size, r.target) for r in got}
    assert sum(t for _, t in groups) == pytest.approx(1.5 * sum(s for s, _ in groups)) and all(t <= 2 * s for s, t in groups)
    largest = max(r["size"] for r in got)
    for s, t in groups:
        assert abs(sum(r.taken for r in got if (r.source_size, r.target) == (s, t)) - t) <= largest
    assert mixing.mix(empty).count() == 0 and mixing.emitted(mixing.mix(empty, carry=True)).count() == 0
    assert mixing.emitted(mixing.mix(docs, carry=True)).columns == docs.columns


def near_brute(rows, width, percent):
    sets, parent = [], {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        w = bytes_of(r[1]).lower().split()
        sets.append((r[0], frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
        parent[r[0]] = r[0]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return collections.Counter((a, len(s), find(a), a == find(a)) for a, s in sets)


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(docs, empty, width):
    assert collections.Counter(map(tuple, near_dedup.near_groups(docs, width).collect())) == near_brute(corpus(), width, 80)
    assert near_dedup.near_groups(empty, width).count() == 0


def test_components(spark):
    random.seed(3)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    label = {n: n for e in links for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: v for n, v in label.items() if n in got} and all(label[n] == n for n in set(label) - set(got))


def contaminated_brute(rows, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = collections.defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((r[0], len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return collections.Counter(out)


def test_contamination(spark, docs, empty):
    rows = corpus()
    items = [(1, rows[80][1]), (2, "kata."), (10, rows[75][1].upper() + "!"), (3, None), (4, "--"), (5, "never there " * 8), (None, "lore lore")]
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(docs, tests)
    assert collections.Counter(map(tuple, got.collect())) == contaminated_brute(rows, [("" if i is None else i, t) for i, t in items])
    assert decontamination.contamination(empty, tests).count() == 0
    none = tests.where("false")
    assert decontamination.contamination(docs, none).where("contaminated").count() == 0


def near_passages_brute(rows, items, size=10, slop=3, lacks=5, lists=3):
    """Documents and items whose windows occur altered but nowhere word for word."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    seen = collections.Counter(w for r in rows for w in words(r[1]))
    out = collections.defaultdict(set)
    for doc, text in rows:
        w = words(text)
        at = collections.defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        for item, t in items:
            v, exact, near = words(t), False, False
            for o in range(max(len(v) - size, 0) + 1 if v else 0):
                p = v[o : o + size]
                rare = sorted(range(len(p)), key=lambda k: (p[k] not in seen, seen[p[k]], k))[:lists]
                n = len(rare)
                met = collections.Counter(i - k for k in rare for i in at[p[k]])
                for start in met:
                    exact |= w[max(start, 0) : max(start, 0) + len(p)] == p and start >= 0
                    close = sum(c for s, c in met.items() if abs(s - start) <= slop)
                    if met[start] >= n or close >= max(n - 1, min(n, 2)):
                        got = sum(any(abs(i - start - k) <= slop for i in at[x]) for k, x in enumerate(p))
                        near |= got >= len(p) - len(p) // lacks
            if near and not exact:
                out[doc].add(str(item))
    return {d: ",".join(sorted(v)) for d, v in out.items()}


def test_proximity(spark):
    random.seed(4)
    say = lambda n: " ".join(random.choices("alpha beta gamma delta eps zeta eta theta iota kappa the of and".split(), k=n))
    passage = "one two three four five six seven eight nine ten"
    texts = [passage, "one two x three four five six seven eight nine ten", "ten nine", passage.replace("seven", "7"), passage.replace("seven", "7").replace("two", "2"), "nine ten " + say(200), say(30) + " " + passage + " two one " + say(30), None, ""]
    texts += [say(300) for _ in range(5)] + [say(20) + " " + " ".join(w for w in passage.split() if w != "six") + " " + say(20), "one clean text of ten new words " * 9]
    rows = list(enumerate(texts))
    items = [(7, passage), (8, passage + " " + say(9)), (9, "nine ten"), (10, "the of the of the and the of and the")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(docs, tests, near=True).collect()
    want = near_passages_brute(rows, items)
    assert {r.doc_id: r.near_items for r in got if r.n_near} == want and {1, 3, len(texts) - 2} <= set(want) and not {0, 7, 8, len(texts) - 1} & set(want)
    assert collections.Counter(tuple(r)[:6] for r in got) == contaminated_brute(rows, items)
    assert decontamination.contamination(docs, tests.where("false"), near=True).where("n_near > 0").count() == 0


def repeats_brute(rows, length=100):
    texts = sorted({(r[0] is None, r[0] or 0, bytes_of(r[1])) for r in rows}, key=lambda x: x[:2])
    seen, out = set(), {}
    for no_id, i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out[(None if no_id else i, b)] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_remove_repeats(spark, empty):
    rows = [r for r in corpus() if r[0] is not None] + [(500, "ab" * 3000, None, None, 0, "", ""), (501, "x" * 99, None, None, 0, "", ""), (502, "x" * 300, None, None, 0, "", ""), (None, "x" * 120, None, None, 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = repeats_brute(rows)
    got = collections.Counter(map(tuple, suffix_dedup.remove_repeats(df).collect()))
    assert got == collections.Counter((r[0], *want[(r[0], bytes_of(r[1]))]) for r in rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_cut_texts_give_the_same(spark):
    rng = random.Random(5)
    text = rng.randbytes(5000)
    assert b"".join(p[: 700 - 100] for _, p in suffix_dedup.pieces(text, 100, 700)) [: len(text) - 99] == text[: len(text) - 99]
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    long, part = say(9000), say(400)
    rows = [(1, long), (2, say(700) + long[3000:5000] + say(90)), (3, part + say(1500) + part), (4, say(10)), (5, long[::-1] + part)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(2)
    want = repeats_brute([(i, t) for i, t in rows])
    for most in (700, 1 << 24):
        got = collections.Counter(map(tuple, suffix_dedup.remove_repeats(df, most=most).collect()))
        assert got == collections.Counter((i, *want[(i, t.encode())]) for i, t in rows)


def test_order_of_suffixes():
    import numpy as np

    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"ab\xff") for _ in range(40)) * 6 + rng.randbytes(200), np.uint8)
    for length in (8, 20, 100):
        where = np.array(rng.sample(range(len(data) - length), 200))
        order, tied = suffix_dedup.multikey_sorted(data, where, length)
        found = [data[i : i + length].tobytes() for i in where[order]]
        assert found == sorted(found) and tied.tolist() == [i > 0 and found[i] == found[i - 1] for i in range(200)]
        assert all(order[i - 1] < order[i] for i in range(1, 200) if tied[i])


def test_a_hot_lead_is_cut_by_context(spark):
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = say(60)
    rows = [(i, say(120) + line + say(60) + (line + "!" if i % 3 else say(5))) for i in range(300)] + [(400 + i, line + "same end of it all " * 8) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    keyed = df.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("h"), "text")
    assert suffix_dedup.splitters(keyed, 100, 64, 1.0)[1]  # leads that fill more than one range
    want = repeats_brute(rows)
    got = collections.Counter(map(tuple, suffix_dedup.remove_repeats(df, sample=1.0).collect()))
    assert got == collections.Counter((i, *want[(i, t.encode())]) for i, t in rows)
    with pytest.raises(TypeError):
        suffix_dedup.remove_repeats(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_html():
    body = "the cat is on the mat and it was a good day for all of us in the house " * 4
    page = f"""<!DOCTYPE html><head><title>T</title></head><body><header>Menu of the site</header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies and you are happy with it</div>
    <article><h1>Title &amp; more</h1><p>One&nbsp;line<br>of text.<p>Second <b>bold</b><script>var t="</p>";</script> part.</p><form>Name <input></form><div id="comments"><p>First!</p></div></article>
    <aside>Side</aside><footer>&copy; us</footer>"""
    assert html_text.main_text(page) == "Title & more\n\nOne line of text.\n\nSecond bold part."
    assert html_text.main_text("") == "" and html_text.main_text("<<<>><p") in ("", "<< >", "<<>")
    short = html_text.main_text(f"<body><p>{body}</p><p>Short one.</p><p>{body}</p><div><a href=x>only</a> <a href=y>links</a></div></body>")
    assert short == "\n\n".join([body.strip(), "Short one.", body.strip()])


def test_html_table(spark):
    rows = [(1, "u", None, "x"), (2, "v", "<article><p>Hi</p></article>", "x"), (2, "v", "<article><p>Hi</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect())) == [(1, "u", "", 0), (2, "v", "Hi", 2), (2, "v", "Hi", 2)]
    assert html_text.extract(df.where("false")).count() == 0


def test_quality(spark, empty):
    random.seed(6)
    good = lambda: " ".join(random.choices(["the", "house", "is", "open", "and", "people", "walk"], k=80))
    bad = lambda: " ".join(w + random.choice(["%%%", "$$$", "&&&"]) for w in good().split())
    rows = [(i, good() if i % 3 else bad(), "en", "s", 1, "", "") for i in range(300)] + [(900, None, None, None, None, None, None), (901, good() * 2000, "en", "s", 1, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (3, 7, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(df, labels, F.col("doc_id") < 200)
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert sum(got[i].predicted == int(i % 3 > 0) for i in range(200, 300)) >= 97 and got[901].predicted == 1 and 0 <= got[900].score <= 1
    carried = quality.score(df, model, carry=True)
    assert carried.select("row.*").columns == df.columns and {r.doc_id: r.score for r in carried.collect()} == {i: r.score for i, r in got.items()}
    assert quality.fit(df, labels.where("false"), F.lit(True)) is None and quality.score(empty, None).count() == 0


def test_quality_fits_whole_documents_within_its_bound(spark, monkeypatch):
    rows = [(0, "abcdefg " * 64_000), (1, "one"), (2, None), (3, "x" * 2000)]  # 1,000 passages, and a few
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda bags, y: seen.append((sorted(map(len, bags)), sorted(y))))
    quality.fit(df, labels, F.lit(True))
    quality.fit(df, labels, F.lit(True), most_passages=999)
    quality.fit(df, labels, F.lit(True), most_docs=2)
    assert seen[0] == ([1, 1, 4, 1000], [0, 0, 1, 1]) and seen[1] == ([1, 1, 4], [0, 1, 1]) and len(seen[2][0]) == 2


def test_mixing_of_ids_of_any_type(spark, docs):
    plain = mixing.mix(docs).collect()
    named = mixing.mix(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))).collect()
    total = lambda rows: collections.Counter((r["size"], r.source_size, r.target) for r in rows)
    assert total(plain) == total(named) and any(r.doc_id == "d7" for r in named)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("op")))
def test_query_runs(spark, sf, name):
    table = {"op9": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    rows, found = spark.read.parquet(f"{sf}/{table}.parquet"), QUERIES[name](spark, sf)
    if name == "op12_divergence":  # one row for each ordered pair of a language's sources, and its terms
        sources = collections.Counter(r.lang for r in rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct().collect())
        assert found.where("part = 'pair'").count() == sum(n * (n - 1) for n in sources.values())
        return
    assert found.count() == rows.count()


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op3_language_id"](spark, sf).join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pipeline.run(spark, sf)
    assert set(docs.columns) <= set(out.columns)
    good = pipeline.good_quality(spark, docs, sf)
    one = pipeline.one_of_each_group(spark, good, sf)
    near = near_brute([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(k[0] for k in near if k[3])
    clean = pipeline.uncontaminated(spark, one, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = contaminated_brute([(r.doc_id, r.text) for r in one.collect()], items)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(k[0] for k in leaks if not k[5])
    assert out.count() == pipeline.mixed(spark, clean, sf).count()
    assert pipeline.sharded(spark, pipeline.mixed(spark, docs.where("false"), sf), sf).count() == 0
