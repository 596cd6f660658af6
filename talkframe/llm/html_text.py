"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is read as raw text and never shown, elements that show no text, those of them that end where a block begins, and elements
#: that hold page furniture.
RAW = frozenset("script style noscript title iframe textarea".split())
HIDDEN = frozenset("template svg canvas object math select option button".split())
INLINE_HIDDEN = frozenset("svg math select option button".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role of an element that name page furniture, and those that only hint at it.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|breadcrumbs?|comments?|comment-?list|complementary|consent|contentinfo|cookies?|disqus|"
    r"footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|pagination|popup|replies|respond|sidebar|sponsor(?:ed)?|toolbar)(?:$|[\s_-]|\d)",
    re.I,
)
HINTS = re.compile(r"(?:^|[\s_-])(?:banner|header|notice|promo|related|share|sharing|signup|skip|social|subscribe|widget)(?:$|[\s_-]|\d)", re.I)
#: Frequent short words of the languages that the density rule knows.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i if in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour qu que qui sa se ses son sur un une vous "
    "aber als am auch auf aus bei das dem den der des die durch ein eine einen einer er es für hat ich ihr im ist mit nach nicht noch oder sich sie sind so um und "
    "uns von war wie wir zu zum zur "
    "al como con del el ella ellos era es esta este fue ha hay las lo los más me muy no nos para pero por si sin sobre su sus también todo tu una y ya yo".split()
)
#: Elements whose end tag is optional: what closes an open one, up to the element that holds them.
CLOSERS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tr": ("tr", "tbody thead tfoot table"), "option": ("option", "select datalist"),
}
CLOSERS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSERS.items()}
#: A tag ends at the first ">" outside quotes; a quote that is never closed is a plain character. Nothing here is tried twice, so pages are read in linear time.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>\"[^\"]*\"|'[^']*'|[^>\"']++|[\"'])*+)(?:>|\Z)|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    inside: int  # the number of the article, main or similar element around it, 0 for none
    furniture: bool
    hinted: bool = False


def standing(name: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """Is an element page furniture, by its name, its names in attributes or because it is hidden; and do its names hint at it?"""
    if name in HIDDEN or (name in FURNITURE and not (inside and name == "header")):
        return True, False
    if name in ("html", "body", "article", "main") or not rest.strip():
        return False, False
    marks = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
    names = [marks.get(k, "") for k in ("class", "id", "role")]
    hidden = "hidden" in marks or marks.get("aria-hidden", "").lower() == "true"
    return hidden or any(map(NAMES.search, names)), any(map(HINTS.search, names))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with what the rules need to know of each. Broken markup is read as far as it goes."""
    out: list[Block] = []
    open_tags: list[tuple[str, bool, bool, bool, int]] = []  # name, is it furniture, is it the article, is it a hint, and where its text begins in `parts`
    counts: Counter[str] = Counter()  # how many of each name are open
    unclosed: set[str] = set()  # raw elements without an end tag in the rest of the page
    parts: list[str] = []
    linked = links = furnished = articles = hints = nth = unseen = 0
    heading = False

    def close() -> None:
        nonlocal parts, linked, heading
        if parts and (text := " ".join("".join(parts).split())):
            out.append(Block(text, linked, heading, nth if articles else 0, furnished > 0, hints > 0))
        parts, linked = [], 0

    def pop() -> str:
        nonlocal furnished, articles, links, hints, unseen
        was = open_tags.pop()
        counts[was[0]] -= 1
        furnished -= was[1]
        articles -= was[2]
        hints -= was[3]
        links -= was[0] == "a"
        if was[0] in INLINE_HIDDEN:
            unseen -= 1
            del parts[was[4] :]
        return was[0]

    at, size = 0, len(page)
    while at < size and (m := TOKEN.match(page, at)):
        at = m.end()
        end, name, rest, text = m.groups()
        if text is not None:
            text = html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        if name is None:
            continue
        name = name.lower()
        if name == "head" and not end:
            continue
        if name in BLOCKS:
            while unseen:
                pop()
            close()
            heading = not end and len(name) == 2 and name[0] == "h" and name[1].isdigit()
        elif name == "br":
            parts.append("\n")
        if end:
            if name in HIDDEN and name not in INLINE_HIDDEN:
                close()
            if counts[name]:
                while pop() != name:
                    pass
        elif name in RAW and not rest.rstrip().endswith("/"):
            stop = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif name in ("script", "style"):
                at = size
            else:
                unclosed.add(name)
        elif name not in VOID and not rest.rstrip().endswith("/"):
            if name == "p" and open_tags and open_tags[-1][0] == name:
                pop()
            elif name in CLOSERS and any(counts[n] for n in CLOSERS[name][0]):
                ends, holders = CLOSERS[name]
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k][0] in ends:
                        while len(open_tags) > k:
                            pop()
                        break
                    if open_tags[k][0] in holders or open_tags[k][0] in FURNITURE or open_tags[k][0] in ("article", "main", "div", "section"):
                        break
            if name != "p" or rest.strip():
                (is_furniture, is_hint), is_article = standing(name, rest, articles > 0), name in ("article", "main")
                if name in HIDDEN and name not in INLINE_HIDDEN:
                    close()
                open_tags.append((name, is_furniture, is_article, is_hint, len(parts)))
                unseen += name in INLINE_HIDDEN
                counts[name] += 1
                nth += is_article and not articles
                furnished += is_furniture
                articles += is_article
                hints += is_hint
                links += name == "a"
    close()
    return out


GOOD, BAD, NEAR_GOOD, SHORT = "good", "bad", "near-good", "short"


def first_pass(found: list[Block], short: int, long: int, low: float, high: float, most_links: float) -> list[str]:
    """Labels that a block earns by itself: by furniture around it, link density, length and stop-word density. Inside an article a block without stop words is
    undecided, elsewhere bad. Where no block of a page has the stop words of a known language, length and link density decide."""
    labels = []
    words = [WORD.findall(b.text.lower()) for b in found]
    densities = [sum(w in STOP_WORDS for w in ws) / len(ws) if ws else 0.0 for ws in words]
    known = any(d >= low for b, d in zip(found, densities, strict=True) if len(b.text) >= short)
    for b, density in zip(found, densities, strict=True):
        if b.furniture or b.linked / len(b.text) > most_links or b.text.startswith(("\xa9", "(c)")):
            labels.append(BAD)
        elif len(b.text) < short:
            labels.append(SHORT)
        elif density >= (high if known else 0.0) and len(b.text) > long:
            labels.append(GOOD)
        elif density >= low or not known:
            labels.append(NEAR_GOOD)
        else:
            labels.append(SHORT if b.inside else BAD)
    return labels


def sides(found: list[Block], labels: list[str]) -> list[tuple[str, str]]:
    """The nearest decided labels before and after each block. Inside an article only its own blocks count, and its ends are good; outside all blocks
    count, and the ends of the page are bad."""

    def one_way(order: range) -> list[str]:
        side, outer, inner, place = [BAD] * len(found), BAD, GOOD, 0
        for i in order:
            if found[i].inside != place:
                inner, place = GOOD, found[i].inside
            side[i] = inner if place else outer
            if labels[i] in (GOOD, BAD):
                outer = inner = labels[i]
        return side

    n = len(found)
    return list(zip(one_way(range(n)), one_way(range(n - 1, -1, -1)), strict=True))


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Undecided blocks inherit from their nearest decided neighbours. Each good side counts one, an article around the block one, a hint at furniture
    takes two: nearly good blocks need one, short ones two (a heading just a good block after it, with a hint in an article only). If a page is left without text, its undecided blocks with words stay."""
    keep = []
    for b, label, (before, after) in zip(found, labels, sides(found, labels), strict=True):
        points = (before == GOOD) + (after == GOOD) + (b.inside > 0) - 2 * b.hinted
        if label == SHORT:
            keep.append(points >= 2 or (b.heading and after == GOOD and (b.inside > 0 or not b.hinted)))
        elif label == NEAR_GOOD:
            keep.append(points >= 1)
        else:
            keep.append(label == GOOD)
    return keep if any(keep) else [label in (SHORT, NEAR_GOOD) and not b.hinted and WORD.search(b.text) is not None for b, label in zip(found, labels, strict=True)]


def main_text(page: str, short: int = 70, long: int = 200, low: float = 0.2, high: float = 0.3, most_links: float = 0.5) -> str:
    """The article's blocks joined by two newlines; empty if none."""
    found = blocks(page)
    keep = second_pass(found, first_pass(found, short, long, low, high, most_links))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_cols: Iterable[str] = ("page_id", "url"), html_col: str = "html", **rules: float) -> DataFrame:
    """One row per page: the id columns, text and n_chars (code points).

    Null or empty html gives the empty text; an article or main element is evidence for undecided blocks only, and pages without one are judged
    by the density rules alone; markup of any length and brokenness is read in linear time; repeated rows are extracted each; an empty table gives an
    empty result; other columns are ignored. Scan only: no shuffle.
    """
    ids = list(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py() or "", **rules) for v in batch.column(len(ids))]
            cols = [*batch.columns[: len(ids)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "text", "n_chars"])

    names = [f"k{i}" for i in range(len(ids))]
    rows = pages.select(*(F.col(c).alias(n) for c, n in zip(ids, names, strict=True)), F.col(html_col).alias("html"))
    shape = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    found = rows.mapInArrow(run, f"{shape}, text string, n_chars bigint")
    return found.select(*(F.col(n).alias(c) for c, n in zip(ids, names, strict=True)), "text", "n_chars")
