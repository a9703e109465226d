"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is read as a sequence: a run of words scores its words times a weight, which depends on the open elements (their
names, classes, ids and roles), and each tag scores a little below zero. One linear scan finds the contiguous region of the
highest score; inside it, runs whose own weight is below zero (adverts, forms, comments and the like within the article) are
left out.

An element adds its evidence to what the elements around it gave; one that says what it holds (a section, or a telling name)
counts FADE times as much as what is around it, so content in a wrapper named after a header is content, and a form within an
article is none. Where names leave next to nothing of a page, it is read again, and elements that hold most of its words count as
nameless wrappers. Weights are fitted by logistic regression on labelled pages: pages written from seeds, and a bounded sample of
the pages at hand that mark their article, whose words inside and outside it are the labels and count AT_HAND times as much.

Defined results: null, empty and wordless pages, and pages whose words all score below zero, give the empty text. Of equal
regions the first one counts. Markup may be cut off or unbalanced anywhere: an unclosed comment, script, style, title or
tag runs to the end; a tag whose quote is never closed ends at its first `>`. Reading is linear in the page and in the depth
of its elements, and a context is one small tuple an element, so very long and hostile pages take time and memory in
proportion. Repeated rows give equal rows, no rows none. Only page_id, url and the html column are read, so others may have
any name.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices

#: Elements whose content is no markup.
RAW = {name: re.compile(rf"</{name}(?![a-z0-9])[^>]*>?", re.I) for name in "script style title textarea iframe".split()}
#: Elements whose content is never text of a page.
UNSEEN = set("noscript template svg object select option button math canvas audio video".split())
#: Elements without an end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand within a line, and so don't part words.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end when another of their kind begins.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Elements that say what they hold, and elements of text, whose names say less.
SECTIONS = set("article main nav header footer aside form section dialog".split())
TEXTUAL = INLINE | set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())

#: How much less what is around a telling element counts.
FADE = 4.0
#: A run that is none of the text costs so many words at most, and a word of it so much at most.
GAP, MOST_LOST = 3, -1.0
#: A text of fewer words, on a page of more than OTHERS times as many, is no main text: wrappers are then read without their names.
FEW, OTHERS = 25, 4
#: What holds so much of a page's words is a wrapper.
WIDE = 0.5

OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
QUOTE_OR_END = re.compile(r"=\s*([\"'])|>")
NAMING = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def features_of(name: str, attrs: str) -> tuple[str, ...]:
    """What an element says of the words in it."""
    found = set() if name in ("html", "body") else {f"<{name}>"}
    for m in NAMING.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        found.update(p.lower() for p in PART.findall(value))
    return tuple(sorted(found))


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """The place of the > that closes a tag, quoted values passed over; -1 if there is none. dead: openings of quotes from
    which no such place is reached, so that no stretch of a page is passed over twice."""
    passed = []
    while m := QUOTE_OR_END.search(page, at):
        if m[1] is None:
            return m.start()
        passed.append(m.start())
        end = -1 if m.start() in dead else page.find(m[1], m.end())
        if end < 0:
            break
        at = end + 1
    dead.update(passed)
    return -1


def sequence(page: str, root, descend: Callable) -> Iterator[tuple]:
    """Yields ("tag", whether it parts blocks, None) and ("text", words, context) in page order.

    A context is what descend(context of the parent, name, attributes) makes of an element; None: nothing in it is seen."""
    names: list[str] = []
    contexts = [root]
    blocks: list[int] = []  # places of the open elements that aren't inline
    inside: Counter = Counter()
    dead: set[int] = set()
    at, end = 0, len(page)

    def close(to: int) -> None:
        for name in names[to:]:
            inside[name] -= 1
        del names[to:], contexts[to + 1 :]
        while blocks and blocks[-1] >= to:
            blocks.pop()

    while at < end:
        m = OPEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and contexts[-1] is not None:
            text = page[at:stop]
            yield "text", html.unescape(text) if "&" in text else text, contexts[-1]
        if not m:
            return
        if page.startswith("<!--", stop):
            over = page.find("-->", stop + 2)
            at = end if over < 0 else over + 3
            continue
        ends = page[stop + 1] == "/"
        named = NAME.match(page, stop + 1 + ends)
        if not named:
            over = page.find(">", stop)
            at = end if over < 0 else over + 1
            continue
        over = page.find(">", named.end()) if ends else _tag_end(page, named.end(), dead)
        if over < 0:
            over = page.find(">", named.end())
        if over < 0:
            return
        at, name = over + 1, named[0].lower()
        yield "tag", name not in INLINE, None
        if ends:
            if inside[name]:
                k = len(names) - 1
                while names[k] != name:
                    k -= 1
                close(k)
        elif name in RAW:
            closing = RAW[name].search(page, at)
            at = closing.end() if closing else end
        elif name not in VOID:
            if blocks and names[blocks[-1]] in SELF_CLOSING.get(name, ()):
                close(blocks[-1])
            if name not in INLINE:
                blocks.append(len(names))
            above = contexts[-1]
            names.append(name)
            inside[name] += 1
            contexts.append(None if above is None or name in UNSEEN else descend(above, name, page[named.end() : over]))


class Weights:
    """A word's weight is `bias` plus the evidence of the open elements; a tag's is `tag`."""

    #: The weight of words outside any element, and whether an element around them holds main text.
    root = (0.0, False)

    def __init__(self, feature: dict[str, float], bias: float, tag: float):
        self.feature, self.bias, self.tag = feature, bias, tag
        self.cache: dict[tuple[str, str], tuple[float, bool]] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def descend(self, above: tuple[float, bool], name: str, attrs: str, named: bool = True) -> tuple[float, bool]:
        """named: whether what the element is called says anything."""
        if not named:
            name, attrs = name if name in TEXTUAL else "div", ""
        found = self.cache.get((name, attrs))
        if found is None:
            parts = features_of(name, attrs)
            found = sum(self.feature.get(f, 0.0) * w for f, w in shares(name, parts)), is_telling(name, parts)
            if len(attrs) < 200:
                if len(self.cache) > 20_000:
                    self.cache.clear()
                self.cache[name, attrs] = found
        own, telling = found
        score, held = above
        return (score / FADE if telling else score) + own, held or self.bias + score > 0

    def of(self, context: tuple[float, bool]) -> float:
        return self.bias + context[0]

    def score(self, words: int, context: tuple[float, bool]) -> float:
        """Of a run of words. A run that is none of the text it stands in costs no more than a tag: it is cut out there
        and doesn't part the text. Elsewhere what a run costs is bounded, so that lists between two blocks of text don't part
        them either."""
        weight = self.of(context)
        if weight < 0:
            return self.tag * (words > 0) if context[1] else max(weight, MOST_LOST) * min(words, GAP)
        return words * weight


def shares(name: str, parts: Iterable[str]) -> list[tuple[str, float]]:
    """How far each part of an element counts: an element of text by its name, half by its class."""
    return [(f, 0.5 if name in TEXTUAL and f != f"<{name}>" else 1.0) for f in parts]


def is_telling(name: str, parts: Iterable[str]) -> bool:
    return name in SECTIONS or name not in TEXTUAL and any(p in TELLING for p in parts)


def evidence(above: dict[str, float], name: str, attrs: str) -> dict[str, float]:
    """The features that Weights.descend sums, for fitting."""
    parts = features_of(name, attrs)
    out = {f: v / FADE for f, v in above.items()} if is_telling(name, parts) else dict(above)
    for f, w in shares(name, parts):
        out[f] = out.get(f, 0.0) + w
    return out


def word_shares(page: str) -> list[float]:
    """The part of a page's words that each element holds, in the order in which sequence() descends to them."""
    above, words = [-1], [0]

    def descend(parent: int, name: str, attrs: str) -> int:
        above.append(parent)
        words.append(0)
        return len(above) - 1

    for kind, value, at in sequence(page, 0, descend):
        if kind == "text":
            words[at] += len(value.split())
    for k in range(len(words) - 1, 0, -1):
        words[above[k]] += words[k]
    return [w / max(1, words[0]) for w in words[1:]]


def main_text(page: str | None, weights: Weights) -> str:
    """The page's main text: blocks joined by one space, white space within them as one.

    Where names leave next to nothing of a page of many words, they mislead: the page is read again, and what holds most of its
    words, whatever it is called, is a wrapper."""
    text, words = best_region(page or "", weights, weights.descend)
    found = len(text.split())
    if found < FEW and words > OTHERS * found:
        shares_left = iter(word_shares(page or ""))
        again, _ = best_region(page or "", weights, lambda above, name, attrs: weights.descend(above, name, attrs, next(shares_left) < WIDE))
        if len(again.split()) > found:
            return again
    return text


def best_region(page: str, weights: Weights, descend: Callable) -> tuple[str, int]:
    """The text of the page's best region, and how many words the page has."""
    parts: list[tuple[str, bool, float]] = []  # text, whether a block begins before it, the weight of its words
    total = best = 0.0
    start = seen = 0
    best_span = (0, 0)
    apart = True
    for kind, value, context in sequence(page, weights.root, descend):
        if kind == "tag":
            total += weights.tag
            apart |= value
            continue
        words = len(value.split())
        seen += words
        if total < 0 and words:
            total, start = 0.0, len(parts)
        weight = weights.of(context)
        parts.append((value, apart, weight))
        apart = False
        total += weights.score(words, context)
        if total > best:
            best, best_span = total, (start, len(parts))
    out = []
    for text, begins, weight in parts[best_span[0] : best_span[1]]:
        # A run that is left out still parts its neighbours.
        out.append((" " if begins else "") + (text if weight > 0 else " "))
    return " ".join("".join(out).split()), seen


#: Names that page parts go by, which written pages draw from.
INSIDE = ["article", "content", "post", "entry", "main", "story", "body", "text", "page content", "article body", "post content", "entry content"]
OUTSIDE = {
    "menu": ["nav", "menu", "navbar", "navigation", "main nav", "breadcrumb", "breadcrumbs", "pagination", "toc", "skip"],
    "header": ["header", "masthead", "top", "site header", "branding", "logo", "topbar"],
    "footer": ["footer", "site footer", "colophon", "bottom", "copyright", "legal", "disclaimer"],
    "sidebar": ["sidebar", "aside", "widget", "related", "recommended", "more", "popular", "trending", "tags", "author bio"],
    "notice": ["cookie", "notice", "consent", "banner", "alert", "gdpr", "modal", "popup", "overlay", "warning", "toast"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "adsense", "outbrain"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search", "contact form"],
    "comments": ["comments", "comment", "respond", "reply", "disqus", "discussion", "reviews"],
    "share": ["share", "social", "sharing", "follow", "print", "byline tools"],
}
#: Names that say nothing about what they hold.
NEUTRAL = ["", "row", "col", "container", "wrapper", "inner", "grid", "box", "block", "module", "panel", "section", "region"]
#: The elements that such parts are marked by.
ELEMENTS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div"], "notice": ["div", "section", "dialog"], "advert": ["div", "ins", "aside"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}


TELLING = {p for names in (INSIDE, *OUTSIDE.values()) for n in names for p in n.split()}

Run = tuple[dict[str, float], int, bool]


def _path(*elements: tuple[str, str]) -> dict[str, float]:
    out: dict[str, float] = {}
    for name, attrs in elements:
        out = evidence(out, name, attrs)
    return out


def labelled_pages(n: int, seed: int = 0) -> Iterator[list[Run]]:
    """Yields written pages as runs: (evidence, words, whether they are main text)."""
    rng = random.Random(seed)
    tags = lambda *names: [(x, "") for x in names]
    of_class = lambda value: f'class="{value}"'

    def element(kind: str) -> tuple[str, str]:
        name = rng.choice(ELEMENTS[kind])
        role = {"menu": " navigation", "header": " banner", "footer": " contentinfo", "sidebar": " complementary"}.get(kind, "") if rng.random() < 0.2 else ""
        named = rng.choice(OUTSIDE[kind]) if rng.random() < 0.8 or name in ("div", "section", "ol", "ul") else ""
        return name, of_class(named + role)

    def neutral() -> list[tuple[str, str]]:
        return [(rng.choice(["div", "div", "section", "span"]), of_class(rng.choice(NEUTRAL))) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))]

    def holder() -> list[tuple[str, str]]:
        pick = rng.random()
        if pick < 0.35:
            return [("article", of_class(rng.choice(INSIDE)) if rng.random() < 0.4 else "")]
        if pick < 0.5:
            return tags("main", "article") if rng.random() < 0.3 else tags("main")
        if pick < 0.75:
            return tags("div")  # nothing tells that it is one
        return [(rng.choice(["div", "section", "td"]), of_class(rng.choice(INSIDE)))]

    def wrapper() -> list[tuple[str, str]]:
        """Around the whole page, named after one part of it."""
        pick = rng.random()
        if pick < 0.2:
            return [("div", of_class(rng.choice(["has", "with", "fixed", "page"]) + " " + rng.choice(["sidebar", "header", "footer", "menu", "banner", "top", "nav"])))]
        return [("div", of_class("wrapper"))] if pick < 0.5 else []

    def outside(base: list, kind: str) -> Iterator[Run]:
        inner = [*base, *neutral(), element(kind), *neutral()]
        for _ in range(rng.randint(1, 5)):
            tail = rng.choice([("p",), ("a",), ("li", "a"), ("ul", "li", "a"), ("span",), ("label",), ("h2",), ("h3",), (), ("div",), ("div", "p"), ("ul", "li"), ("div", "div", "span")])
            yield _path(*inner, *tags(*tail)), rng.randint(1, 12), False

    for _ in range(n):
        wrap = [*tags("html", "body"), *wrapper()]
        page: list[Run] = []
        for kind in rng.sample(sorted(OUTSIDE), rng.randint(2, 6)):
            page += outside(wrap, kind)
        held = [*wrap, *neutral(), *holder()]
        for _ in range(rng.randint(2, 12)):
            tail = rng.choice([("p",)] * 6 + [("h1",), ("h2",), ("header", "h1"), ("ul", "li"), ("blockquote", "p"), ("p", "b"), ("p", "a"), ("table", "tr", "td"), ("pre",), ("figure", "figcaption"), (), ("div",), ("div", "p"), ("section", "p"), ("dl", "dd"), ("p", "em"), ("div", "div", "span")])
            last = [("p", of_class(rng.choice(["more", "lead", "intro", "top", "note", "first"])))] if rng.random() < 0.1 else tags(*tail)
            page.append((_path(*held, *neutral(), *last), rng.randint(1, 60), True))
        for kind in rng.sample(["advert", "form", "comments", "sidebar", "share", "notice", "footer", "menu"], rng.randint(0, 3)):
            page += outside(held, kind)
        for kind in rng.sample(sorted(OUTSIDE), rng.randint(1, 4)):
            page += outside(wrap, kind)
        yield page


def marked_runs(page: str) -> list[Run]:
    """The runs of a page that marks one article, labelled by whether they are in it and in no other part of a page."""

    def descend(above, name, attrs):
        found, held, other = above
        return evidence(found, name, attrs), held or name == "article", name in ("nav", "aside", "footer", "form", "dialog") or other and name != "article"

    if len(re.findall(r"<article\b", page, re.I)) != 1:
        return []
    out = [(c[0], len(v.split()), c[1] and not c[2]) for kind, v, c in sequence(page, ({}, False, False), descend) if kind == "text"]
    return [r for r in out if r[1]]


#: A run of a page at hand counts as so many of written pages.
AT_HAND = 4.0


def fit(runs: list[Run], at_hand: list[Run] = (), rounds: int = 50) -> Weights:
    """Logistic regression, runs weighing as the root of their words."""
    # Runs of one evidence and label are one.
    mass_of: dict[tuple, float] = {}
    for own, mass in ((runs, 1.0), (at_hand, AT_HAND)):
        for found, words, label in own:
            key = tuple(sorted(found.items())), label
            mass_of[key] = mass_of.get(key, 0.0) + mass * words**0.5
    names = sorted({f for (found, _) in mass_of for f, _ in found})
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(mass_of), len(names) + 1))
    x[:, -1] = 1
    for i, (found, _) in enumerate(mass_of):
        for f, v in found:
            x[i, place[f]] = v
    y = np.array([label for _, label in mass_of], float)
    mass = np.array(list(mass_of.values()))
    w = np.zeros(len(names) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (mass * (p - y)) / mass.sum() + 1e-4 * w
        curve = (x.T * (mass * np.maximum(p * (1 - p), 1e-3))) @ x / mass.sum() + 2e-4 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return Weights(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]), -0.02)


def trained(marked: Iterable[str] = (), pages: int = 400, seed: int = 0) -> Weights:
    """Weights from written pages and from pages that mark their article."""
    runs = [run for page in labelled_pages(pages, seed) for run in page]
    return fit(runs, [run for page in marked for run in marked_runs(page)])


#: Pages that weights are fitted on besides written ones: so many at most, of so many characters at most.
SAMPLE_PAGES, SAMPLE_CHARS = 200, 100_000


def sample(pages: DataFrame, id_col: str, html_col: str, most: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """At most `most` pages with an article, those of the least hash. Hashes are asked for first, so that the driver gets
    few numbers from each task and then no more pages than it keeps."""
    told = pages.filter(F.col(html_col).contains("<article") & (F.char_length(html_col) <= chars))
    told = told.select(F.xxhash64(id_col, html_col).alias("hash"), F.col(html_col).alias("page"))
    least = told.select("hash").orderBy("hash").limit(most).collect()
    return [r.page for r in told.filter(F.col("hash") <= least[-1].hash).limit(most).collect()] if least else []


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages' page_id, url and main text."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    weights = trained(sample(rows, "page_id", "html"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x, weights) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return map_arrow(rows, run, "page_id bigint, url string, text string")


def op10_html_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("bigint"))
