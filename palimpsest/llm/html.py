"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand (in a paragraph, a heading, a link, a
box that is not the article, ...) and tags cost by their name; a linear scan finds the contiguous region
of the largest sum, which is the article. The weights are log-odds counted on labelled pages: pages that
mark their article with <article> or <main> label themselves, and a bounded sample of them is enough. Blocks of
the region that lie in a menu, sidebar, form, advert, comment list or the like are left out.

Controls, drawings and embedded objects are left out up to their own end tag, and nothing where there is none;
only raw text (scripts, styles and the like) without an end goes on to the end of the page.

Cases: null or empty html gives an empty text; markup may be cut off, unclosed or badly nested; all of a very
long page is read and none of its text dropped; repeated rows are done each; an empty table gives no rows;
without labelled pages the weights are the defaults below; only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import lean, ship, table

#: The sample that weights are counted on: so many pages of at most so many bytes each.
SAMPLE_PAGES = 400
SAMPLE_BYTES = 65_536

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^\"'>]*(?:\"[^\"]*\"[^\"'>]*|'[^']*'[^\"'>]*)*)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: Left out up to their own end tag; one that has none (an option's is optional) is a tag like others.
_LEFT_OUT = frozenset("noscript template svg select option button object canvas".split())
_SKIP = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(sorted(_RAW))})(?=[\s/>])[^>]*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)|{_TAG.pattern}", re.I | re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BOX = frozenset("nav aside footer form menu head dialog fieldset".split())
_BOX_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo complementary cookie "
    "cookies disqus footer form gdpr masthead menu nav navbar navigation newsletter notice notices paywall popup promo promoted related replies "
    "reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


DEFAULTS = {"word p": 1.0, "word heading": 0.6, "word other": 0.9, "word link": -0.5, "word box": -0.5, "tag": -0.1, "tag inline": -0.03, "tag box": -0.1}
#: The most that one block's words cost: a box that stands inside an article should not cut it in two.
BOX_BLOCK = 1.0


def _boxed(name: str, attrs: str, in_article: bool) -> bool:
    if name in _BOX or name == "header" and not in_article:
        return True
    for m in _NAMES.finditer(attrs):
        if _BOX_WORDS & set(re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())):
            return name not in ("html", "body", "article", "main")
    return False


def _ends(page: str) -> dict[int, int]:
    """For the elements to leave out, by the place of the tag: where they end, if they do before what holds them."""
    stack: list[tuple[str, int]] = []
    held: Counter[str] = Counter()
    out: dict[int, int] = {}
    for m in _SKIP.finditer(page):
        closing, name, attrs = m.groups()[1:]
        if name is None:
            continue
        name = name.lower()
        if not closing:
            if name not in _VOID and not attrs.endswith("/"):
                stack.append((name, m.start()))
                held[name] += 1
            continue
        while held[name]:
            top, start = stack.pop()
            held[top] -= 1
            if top == name:
                if name in _LEFT_OUT:
                    out[start] = m.end()
                break
    return out


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text, in_article): kind 'tag ...' for tags, 'word ...' for stretches of text, 'break' between blocks."""
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is a box
    boxes = links = articles = 0
    held: Counter[str] = Counter()  # how many of each name are open, so that stray end tags take no search
    block, at, n = "other", 0, len(page)
    ends: dict[int, int] | None = None

    def text(a: int, b: int) -> tuple[str, str, bool]:
        kind = "box" if boxes else "link" if links else block
        return f"word {kind}", html.unescape(page[a:b]), bool(articles)

    def close(depth: int) -> None:
        nonlocal boxes, links, articles
        while len(stack) > depth:
            name, box = stack.pop()
            held[name] -= 1
            boxes, links, articles = boxes - box, links - (name == "a"), articles - (name in ("article", "main"))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield text(at, n)
            return
        if lt > at:
            yield text(at, lt)
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            if not re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                yield text(lt, lt + 1)
                at = lt + 1
                continue
            end = page.find(">", lt)  # a quote that never ends, or a tag that is cut off
            name, attrs, closing = re.match(r"</?([a-zA-Z][^\s/>]*)", page[lt : lt + 64])[1].lower(), "", page[lt + 1] == "/"
            at = n if end < 0 else end + 1
        else:
            name, attrs, closing, at = m[2].lower(), m[3], bool(m[1]), m.end()
        if name in _RAW:
            if not closing and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = n if end is None else end.end()
            continue
        if name in _LEFT_OUT and not closing:
            ends = _ends(page) if ends is None else ends
            if lt in ends:
                at = ends[lt]
                continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if held[name] else None
            box = bool(boxes)
            if depth is not None:
                close(depth)
        else:
            if name in _BLOCK and any(x == "p" for x, _ in stack[-4:]):
                depth = max(i for i, (x, _) in enumerate(stack) if x == "p")
                if all(x not in _BLOCK for x, _ in stack[depth + 1 :]):
                    close(depth)
            own = _boxed(name, attrs, bool(articles))
            if name not in _VOID and not attrs.endswith("/"):
                stack.append((name, own))
                held[name] += 1
                boxes, links, articles = boxes + own, links + (name == "a"), articles + (name in ("article", "main"))
            box = bool(boxes)
        if name in _BLOCK:
            block = ("heading" if name in _HEADINGS else "p" if name in ("p", "blockquote", "pre") else "other") if not closing else "other"
            yield "break", "", bool(articles)
        elif name == "br":
            yield "word " + ("box" if boxes else "link" if links else block), " ", bool(articles)
        yield ("tag box" if box else "tag" if name in _BLOCK else "tag inline"), name, bool(articles)


def weights(pages: Iterable[str]) -> dict[str, float]:
    """Log-odds that a word of a kind is the article's, and costs of tags by how much rarer they are there."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for kind, text, article in events(page):
            if kind != "break":
                (inside if article else outside)[kind] += len(text.split()) if kind.startswith("word") else 1
    if not sum(v for k, v in inside.items() if k.startswith("word")):
        return dict(DEFAULTS)
    out = {}
    for kind, default in DEFAULTS.items():
        group = kind.split()[0]
        a = (inside[kind] + 1) / (sum(v for k, v in inside.items() if k.startswith(group)) + 1)
        b = (outside[kind] + 1) / (sum(v for k, v in outside.items() if k.startswith(group)) + 1)
        seen = inside[kind] + outside[kind] > 20
        odds = log(a / b)
        if not seen:
            out[kind] = default
        elif group == "tag":  # a tag never speaks for the article
            out[kind] = default * min(2.0, max(0.25, 1 - odds / 2))
        elif default > 0:
            out[kind] = min(3.0, max(0.2, odds))
        else:
            out[kind] = max(-4.0, min(-0.2, odds))
    return out


def scored(page: str, weight: dict[str, float]) -> tuple[list[float], list[int], list[list[str]]]:
    """The page as a sequence: the score of each tag and of each stretch of words, the block it stands in, and the
    blocks' texts. The words of a stretch weigh alike, so a best region never ends inside one, and a stretch stands
    for its words. What counts against a block's words is BOX_BLOCK at most."""
    scores: list[float] = []
    where: list[int] = []
    blocks: list[list[str]] = [[]]
    left, any_words = BOX_BLOCK, False
    for kind, text, _ in events(page):
        if kind == "break":
            if any_words:
                blocks.append([])
                left, any_words = BOX_BLOCK, False
            continue
        if kind.startswith("tag"):
            score = weight[kind]
        else:
            n = len(text.split())
            score = max(n * weight[kind], -left)
            left += min(0.0, score)
            any_words |= n > 0
            if kind != "word box":
                blocks[-1].append(text)
        scores.append(score)
        where.append(len(blocks) - 1)
    return scores, where, blocks


def best_region(scores: list[float]) -> tuple[int, int]:
    """start, end of the contiguous part of the largest sum, if any is above 0; of equals the one that ends first."""
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, span = run, (start, i + 1)
    return span


def extract(page: str | None, weight: dict[str, float]) -> str:
    scores, where, blocks = scored(page or "", weight)
    start, end = best_region(scores)
    if start == end:
        return ""
    texts = (" ".join("".join(parts).split()) for parts in blocks[where[start] : where[end - 1] + 1])
    return "\n\n".join(t for t in texts if t)


def fit(pages: DataFrame, *, html_col: str = "html") -> dict[str, float]:
    """Weights from the labelled pages with the smallest hashes: the driver holds SAMPLE_PAGES * SAMPLE_BYTES at most."""
    labelled = pages.select(F.col(html_col).alias("h")).filter((F.octet_length("h") <= SAMPLE_BYTES) & F.col("h").rlike("(?i)<(article|main)[ >]"))
    hashed = labelled.withColumn("x", F.xxhash64("h"))
    least = [r.x for r in hashed.select("x").distinct().orderBy("x").limit(SAMPLE_PAGES).collect()]
    return weights(sorted(r.h for r in hashed.filter(F.col("x").isin(least)).select("h").distinct().collect())) if least else dict(DEFAULTS)


def extract_pages(pages: DataFrame, weight: dict[str, float], *, keep: list[str], html_col: str = "html") -> DataFrame:
    """keep..., text, n_chars for each page."""

    ship(pages.sparkSession)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), weight) for x in batch.column(len(keep))]
            cols = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(lean(run), f"{schema}text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fit(pages), keep=["page_id", "url"])
