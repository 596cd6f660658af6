"""The two passes of operator 9 against a plain twin that looks its neighbours up one by one; which rule decides how often; long and broken pages."""

import collections
import random
import time

from talkframe.llm import html_text
from talkframe.llm.html_text import BAD, GOOD, NEAR_GOOD, SHORT, Block

RULES = dict(short=70, long=200, low=0.2, high=0.3, most_links=0.5)


def decided_side(found, labels, i, step):
    """The nearest decided label from block i on, looked for one block at a time."""
    j = i + step
    while 0 <= j < len(found):
        if found[i].inside and found[j].inside != found[i].inside:
            return GOOD
        if labels[j] in (GOOD, BAD):
            return labels[j]
        j += step
    return GOOD if found[i].inside else BAD


def twin(found):
    def density(b):
        words = html_text.WORD.findall(b.text.lower())
        return sum(w in html_text.STOP_WORDS for w in words) / len(words) if words else 0

    known = any(len(b.text) >= 70 and density(b) >= 0.2 for b in found)
    labels = []
    for b in found:
        d, n = density(b), len(b.text)
        if b.furniture or 2 * b.linked > n or b.text[0] == "\xa9" or b.text[:3] == "(c)":
            labels.append(BAD)
        elif n < 70:
            labels.append(SHORT)
        elif known and d < 0.2:
            labels.append(SHORT if b.inside else BAD)
        elif n > 200 and (d >= 0.3 or not known):
            labels.append(GOOD)
        else:
            labels.append(NEAR_GOOD)
    keep = []
    for i, b in enumerate(found):
        good = [decided_side(found, labels, i, step) == GOOD for step in (-1, 1)]
        points = sum(good) + bool(b.inside) - 2 * b.hinted
        if labels[i] == SHORT:
            keep.append(points > 1 or (b.heading and good[1] and (bool(b.inside) or not b.hinted)))
        else:
            keep.append(labels[i] == GOOD or (labels[i] == NEAR_GOOD and points > 0))
    return labels, keep if any(keep) else [x in (SHORT, NEAR_GOOD) and not b.hinted for x, b in zip(labels, found)]


def random_blocks(rng):
    out, article, nth = [], 0, 0
    for _ in range(rng.randrange(14)):
        if rng.random() < 0.3:
            nth += article == 0
            article = 0 if article else nth
        words = rng.choice((["the", "a", "house", "of", "tree"], ["blorp", "zint", "the", "kark", "vemp"], ["blorp", "zint"]))
        text = " ".join(rng.choices(words, k=rng.choice((2, 10, 25, 80))))
        out.append(Block(text, rng.choice((0, 0, 0, len(text))), rng.random() < 0.2, article, rng.random() < 0.15, rng.random() < 0.15))
    return out


def test_passes_equal_their_twin():
    rng = random.Random(3)
    for _ in range(800):
        found = random_blocks(rng)
        labels = html_text.first_pass(found, **RULES)
        assert (labels, html_text.second_pass(found, labels)) == twin(found)


def test_density_rules_decide_inside_articles(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    inside = collections.Counter()
    for page in pages:
        found = html_text.blocks(page)
        inside.update(label for b, label in zip(found, html_text.first_pass(found, **RULES)) if b.inside)
    assert inside[GOOD] > 400 and inside[NEAR_GOOD] > 800 and inside[SHORT] > 800
    bare = [html_text.main_text(p.replace("<article>", "").replace("</article>", "")) for p in pages]
    whole = [html_text.main_text(p) for p in pages]
    assert sum(map(len, bare)) >= 0.8 * sum(map(len, whole))


def test_article_is_evidence_only():
    good = "<p>" + "the house of the tree and the cat is on the mat in the sun " * 6 + "</p>"
    menu = "<ul><li><a href=a>One link here</a></li><li><a href=b>Two links here</a></li></ul>"
    text = html_text.main_text(f"<main><h1>Title</h1>{good}<p>Short one.</p>{good}{menu}</main>")
    assert text.startswith("Title\n\n") and "Short one." in text and "link" not in text
    assert "Prior studies" in html_text.main_text(f'<article>{good}<section class="related-work"><h2>Prior studies</h2>{good}</section></article>')
    assert "Like us" not in html_text.main_text(f'<body>{good}<div class="social">Like us</div>{good}</body>')
    assert "dense" not in html_text.main_text(f'<article>{good}<div id="comments">{good.replace("cat", "dense")}</div></article>')


def test_broken_and_long_pages():
    assert html_text.main_text("<article><p>keep</p><button>Go<p>lost text...</article>") == "keep\n\nlost text..."
    assert html_text.main_text("<article><p>A <button>x</button> b <svg><text>y</text></svg>c</p></article>") == "A b c"
    assert html_text.main_text("<article><p>one</p><textarea>two<p>three</p></article>") != ""
    began = time.time()
    for piece in ("<a b='", "<a b=\"x' c='", "<textarea>x", "<b>", "<!-", "<td>", "</p", "<p class='ad"):
        html_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 60
    words = " ".join(f"the word {i} of it" for i in range(150_000))
    assert html_text.main_text(f"<article><p>{words}</p></article>") == words
