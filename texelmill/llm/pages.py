"""Main text of web pages: the maximum-scoring stretch of words (positive) and tags (negative), with weights from labelled pages."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled pages that weights are learned from, about.
MOST_PAGES = 2000
LABELS = frozenset(("article", "main"))
#: Elements that are never article text.
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select option textarea input label fieldset dialog menu iframe object embed svg canvas audio video map math".split()
)
#: Words in class, id or role that name parts beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar side widget "
    "cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond disqus reply replies "
    "share sharing social related recommended complementary contentinfo search pagination pager".split()
)
#: Words that leave a listed one's meaning as it is (comment-list), and first or last words of names that tell about something around or elsewhere (has-sidebar, comments-open).
PARTS = frozenset("area bar block body box button buttons count form icon icons item items link links list section site slot unit".split())
ABOUT_FIRST = frozenset("has no with without is not hide show tag category cat format status".split())
ABOUT_LAST = frozenset("open closed enabled disabled on off".split())
#: An element that holds at least one of so many of the page's words outside links is no part beside the article, if its name is not listed as a whole.
WRAPS = 3
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
#: Elements that a new one of their kind ends, and what bounds the search for one to end.
CLOSES_ITSELF = {"p": frozenset(), "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)""", re.DOTALL)
_STOP = re.compile(r""">|=\s*+["']""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/>])([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Names of units that are words: outside links, in links. The mark is the opening tag of a labelled element.
WORDS = ("", "#")
MARK = "+"

Unit = tuple[str, str, bool]  # name of a tag, or one of WORDS for text; the text; whether a labelled element is open


def _tag_end(page: str, at: int) -> int:
    """Where the ``>`` stands that ends a tag, -1 for none. A value reaches to its closing quote, however far; a quote without one is a plain sign."""
    inside = -1
    while m := _STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        close = page.find(m[0][-1], at)
        if close >= 0:
            within = page.find(">", at, close)
            inside = within if within >= 0 else inside
            at = close + 1
    return inside  # no end outside of values: that within the last one counts


def _beside(attributes: str) -> int:
    """2 if a name in class, id or role means a part beside the article as a whole, 1 if one has a listed word among others, else 0."""
    most = 0
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() not in ("class", "id", "role"):
            continue
        for name in (m[2] or m[3] or m[4] or "").split():
            own = [w.lower() for w in _WORD.findall(name)]
            if not BESIDE.isdisjoint(own) and own[0] not in ABOUT_FIRST and own[-1] not in ABOUT_LAST:
                most = max(most, 1 + all(w in BESIDE or w in PARTS for w in own))
    return most


def units(page: str, whole: bool = False) -> Iterator[Unit]:
    """Text runs and tags of a page in order. Dropped elements give one tag named ``-``; their content gives nothing. With ``whole`` only raw elements are dropped, so parts beside the article are seen too.

    Missing closing tags end with an element around them. A raw element without an end reaches to the end of the page. The first labelled element inside
    a dropped one that has no end yet ends the dropping. An element whose name has a listed word among others, and a labelled one of a listed name, is dropped unless it holds one of
    WRAPS words of the page or more. Time and memory are linear in the page's length, whatever its tags.
    """
    if whole:
        return _walk(page, {}, None, whole)
    held: dict[int, int] = {}
    found = list(_walk(page, held, None))
    total = held.pop(-1)
    if held:
        found = list(_walk(page, {}, {at for at, n in held.items() if n and n * WRAPS >= total}))
    return iter(found)


def _walk(page: str, held: dict[int, int], wraps: set[int] | None, whole: bool = False) -> Iterator[Unit]:
    """Units of a page. Doubtful elements are kept where ``wraps`` has them, or all if it is None; ``held`` gets the words outside links of each by where it begins, and of all at -1."""
    stack: list[str] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # where each name stands in the stack
    blocks: list[int] = []  # where names stand that are not inline
    doubtful: list[tuple[int, int, int]] = []  # depth, begin and words before of those that are open
    drop = 0  # depth of the stack at which the open dropped element stands, 0 for none
    labels, seen, at, links, total = 0, False, 0, 0, 0
    size = len(page)

    def pop(to: int) -> None:
        nonlocal drop, labels, links
        while len(stack) > to:
            if drop and len(stack) == drop:
                drop = 0
            if doubtful and doubtful[-1][0] == len(stack):
                _, begin, before = doubtful.pop()
                held[begin] = total - before
            name = stack.pop()
            places[name].pop()
            if name not in INLINE:
                blocks.pop()
            links -= name == "a"
            if name in LABELS and labels:
                labels -= 1

    while at < size:
        m, end = _TAG.search(page, at), 0
        if m and m[2] is not None and (end := _tag_end(page, m.end())) < 0:  # no ``>`` follows, so no tag does, but an open comment may
            comment = page.find("<!--", m.end())
            m, size = None, comment if comment >= 0 else size
        text = page[at : m.start() if m else size]
        if text and not drop:
            total += 0 if links else len(text.split())
            yield WORDS[links > 0], html.unescape(text), labels > 0
        if m is None:
            break
        if m[2] is None:
            at = m.end()
            continue
        attributes, at = page[m.end() : end], end + 1
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if places[name]:
                was = drop
                pop(places[name][-1])
                if not was:
                    yield name, "", labels > 0 and name not in LABELS
            elif not drop:
                yield name, "", labels > 0
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            if not drop:
                yield "-", "", labels > 0
            continue
        if name in LABELS and drop and not seen and not _beside(attributes):
            drop = 0
        if name in CLOSES_ITSELF:
            bound = blocks[-1:] if name == "p" else [places[b][-1] for b in CLOSES_ITSELF[name] if places[b]]
            if places[name] and places[name][-1] >= max(bound, default=-1):
                pop(places[name][-1])
        out = doubt = False
        if not drop and not whole and name != "body" and name != "html":
            beside = 0 if name in DROPPED else _beside(attributes)
            doubt = beside == (2 if name in LABELS else 1)
            out = name in DROPPED or (wraps is not None and m.start() not in wraps if doubt else beside == 2 and name not in LABELS)
        if not drop:
            yield "-" if out else MARK if name in LABELS and not labels else name, "", labels > 0
        if doubt:
            held[m.start()] = 0
        if name not in VOID and not attributes.endswith("/"):
            places[name].append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append(name)
            links += name == "a"
            if out:
                drop = len(stack)
            elif name in LABELS and not drop:
                labels, seen = labels + 1, True
            if doubt:
                doubtful.append((len(stack), m.start(), total))
    pop(0)
    held[-1] = total


@dataclass
class Weights:
    """Score of a word, of one in a link, of the opening of a marked region, of the tags seen in labelled pages, and of any other tag."""

    word: float
    link: float
    mark: float
    tags: dict[str, float]
    other: float


#: Pseudo-counts of (inside, outside) of a thousand units each, for what the sample has not seen.
PRIOR_WORDS, PRIOR_UNITS, PRIOR_TAG = (900.0, 450.0), 1000.0, 1.0
#: The smallest cost of a tag.
LEAST_TAG = -0.05


def _weights(counts: dict[tuple[str, bool], float]) -> Weights:
    total = [PRIOR_UNITS + sum(n for (_, side), n in counts.items() if side is inside) for inside in (True, False)]

    def odds(name: str, prior: tuple[float, float]) -> float:
        inside, outside = counts.get((name, True), 0) + prior[0], counts.get((name, False), 0) + prior[1]
        return math.log(inside / total[0]) - math.log(outside / total[1])

    tags = {name: min(odds(name, (PRIOR_TAG, PRIOR_TAG)), LEAST_TAG) for name, _ in counts if name not in WORDS and name != MARK}
    word = max(odds("", PRIOR_WORDS), 0.05)
    link = min(max(odds("#", (PRIOR_TAG, PRIOR_TAG)), -word), word)
    return Weights(word, link, max(odds(MARK, (PRIOR_TAG, PRIOR_TAG)), 0.0), tags, min(odds("?", (PRIOR_TAG, PRIOR_TAG)), LEAST_TAG))


def fit(pages: DataFrame, html_column: str = "html", most: int = MOST_PAGES) -> Weights:
    """Weights from about ``most`` labelled pages, those that mark their text by an article or main element, chosen by a hash of the page.

    The pages are read with the parts beside the article in them, so that their words and tags count as outside. A word's weight is the log of how much more often a unit inside the marked
    region is a word than one outside, and never below 0.05; a tag's likewise, never above -0.05. A word in a link weighs by its own odds, between minus and plus a word's weight. The tag that opens the region belongs to
    it and so gets a positive weight. Without labelled pages the pseudo-counts decide.
    """
    page = F.col(html_column)
    labelled = pages.select(page.alias("page")).where(F.lower("page").rlike("<(article|main)[ \\t\\r\\n/>]"))
    n = labelled.count()
    share = (F.xxhash64("page").cast("double") + 2.0**63) / 2.0**64
    chosen = labelled.where(share * n < most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for page in batch.column("page").to_pylist():
                for name, text, inside in units(page, whole=True):
                    found[name, inside or name == MARK] += len(text.split()) if name in WORDS else 1
            if found:
                yield pa.RecordBatch.from_pydict({"name": [k[0] for k in found], "inside": [k[1] for k in found], "n": list(found.values())})

    rows = chosen.mapInArrow(run, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n")).collect()
    return _weights({(r.name, r.inside): float(r.n) for r in rows})


def scores(kept: list[Unit], weights: Weights) -> list[float]:
    """The score of each unit. Within a marked region a tag has the odds of one that is known to be inside, the least cost, and words in links are words."""
    out = []
    for name, text, inside in kept:
        if name in WORDS:
            out.append((weights.word if inside or not name else weights.link) * len(text.split()))
        elif name == MARK:
            out.append(weights.mark)
        else:
            out.append(LEAST_TAG if inside else weights.tags.get(name, weights.other))
    return out


def best_stretch(scored: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous stretch with the largest sum above 0, the one that ends first of equal ones; (0, 0) if there is none. One scan."""
    best, best_range, now, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scored):
        if now <= 0:
            now, begin = 0.0, i
        now += score
        if now > best:
            best, best_range = now, (begin, i + 1)
    return best_range


def main_text(page: str, weights: Weights) -> str:
    """The best contiguous region's text: the first of equal ones; empty when no word is left."""
    kept = list(units(page))
    parts = [text if name in WORDS else "" if name in INLINE else " " for name, text, _ in kept[slice(*best_stretch(scores(kept, weights)))]]
    return " ".join("".join(parts).split())


def extract_main_text(pages: DataFrame, weights: Weights, html_column: str = "html", out: str = "text") -> DataFrame:
    """The same rows without ``html_column``, plus ``out`` (string) and ``n_chars`` (long, code points); own columns of these names are replaced.

    Character references are decoded, white space within a block is one space, blocks in page order are joined by one space. A null or empty page, and one without words outside
    dropped elements, gives an empty text. No shuffle; each page is read whole and on its own.
    """
    rest = [c for c in pages.columns if c not in (html_column, out, "n_chars")]
    source = pages.select(*rest, F.col(html_column).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) if page else "" for page in batch.column("__html").to_pylist()]
            columns = [batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*rest, out, "n_chars"])

    schema = T.StructType([*[pages.schema[c] for c in rest], T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])
    return source.mapInArrow(run, schema)
