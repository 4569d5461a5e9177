"""Main text of web pages by a maximum-scoring subsequence of their tokens.

A page is a sequence of tags and words. Words score positive or negative by the elements around them, tags cost:
the weights are log-odds of standing inside the main text, learned from pages that mark it (an article or main
element). A single linear scan finds the contiguous run of tokens with the greatest sum; its blocks, without what
never is main text, are the page's text.

Inside a marked main region nothing is weighed against being text: words there count at least KEPT, so that lists or
headings that pages use elsewhere for menus do not cost an article its end. Blocks inside it that are something else
are left out one by one and count nothing either way: those whose class, id or role the marked pages have outside
their main region, and containers that are named as comments, adverts or the like as a whole (`comment-list`, but not
`share-prices`), for which marked pages give no evidence as they may have them inside.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.store import free_name, ship

#: Bound of the labelled pages that weights are learned from.
TRAIN_PAGES = 300
#: The least score of a word in a marked region, the least of a tag there, and the greatest log-odds of a key.
KEPT, TAG_INSIDE, MOST = 0.5, -0.01, 4.0
#: A class, id or role stands for something else than text if its words' log-odds are at most this, on as many pages.
APART, LEAST_PAGES = -2.5, 3

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "noscript", "template", "svg", "math", "iframe", "object", "select", "title"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that are no main text wherever they stand.
_NEVER = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
_MAIN = {"article", "main"}
#: Containers, and names of what is no main text though it often stands inside a main region.
_CONTAINERS = {"div", "section", "aside", "ul", "ol", "dl", "table", "figure", "header"}
_PRIOR = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|comments?|disqus\w*|replies|respond|sidebar|cookies?|consent|notices?|newsletter|subscribe|share|sharing|social|related|breadcrumbs?|menu|nav|navbar|popup|modal", re.I)
#: What such a name may be joined with and still name the container alone.
_LAYOUT = {"area", "banner", "bar", "block", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "left", "links", "list", "main", "outer", "panel", "posts", "right", "section", "slot", "title", "top", "unit", "user", "widget", "wrap", "wrapper", ""}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


@dataclass
class Weights:
    """Log-odds by element key for words and for tags; a key is the element's name, or name and class, id or role.
    apart are the classes, ids and roles whose blocks are left out inside a marked region."""

    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)
    apart: frozenset[str] = frozenset()
    known: bool = False


def _is_named_apart(element: str, names: list[str]) -> bool:
    def named(name: str) -> bool:
        parts = [p for p in re.split("[-_]", name.lower()) if not p.isdigit()]
        prior = [bool(_PRIOR.fullmatch(p)) for p in parts]
        return any(prior) and all(x or p in _LAYOUT for x, p in zip(prior, parts, strict=True))

    return element in _CONTAINERS and any(map(named, names))


class Around:
    """What is open at a place: one record for each open element, with sums from the outermost inwards, so that opening
    and closing cost the same however deep a page is nested."""

    __slots__ = ("anchor", "apart", "counts", "keys", "main", "name", "never", "outer", "weight")

    def __init__(self, outer: Around | None, name: str, keys: tuple[str, ...], names: list[str], w: Weights) -> None:
        self.outer, self.name, self.keys = outer, name, keys
        self.counts = [0, 0]
        #: The nearest element, itself counted, that is not inline.
        self.anchor = self if name not in _INLINE or outer is None else outer.anchor
        in_main = outer is not None and outer.main
        self.main = in_main or name in _MAIN
        self.never = (outer is not None and outer.never) or name in _NEVER or (name == "header" and not in_main)
        other = in_main and name not in _MAIN and (_is_named_apart(name, names) or any(x in w.apart for x in names))
        self.apart = (outer is not None and outer.apart) or other
        own = sum(w.word.get(k, 0.0) for k in keys if k not in ("html", "body"))
        self.weight = own + (outer.weight if outer is not None else 0.0)


class Token:
    __slots__ = ("around", "block", "keys", "tag", "text")

    def __init__(self, tag: str | None, keys: tuple[str, ...], text: str, block: int, around: Around | None) -> None:
        self.tag, self.keys, self.text, self.block, self.around = tag, keys, text, block, around


def _tag_end(page: str, at: int, size: int) -> int:
    """Where the tag that opens at `at` ends (its >), not counting any in quotes after an equals sign; -1 if it never
    does. A quote that is not closed is no quote."""
    while True:
        close = page.find(">", at)
        if close < 0:
            return -1
        equals = page.find("=", at, close)
        while equals >= 0:
            k = equals + 1
            while k < close and page[k].isspace():
                k += 1
            if k < close and page[k] in "\"'":
                end = page.find(page[k], k + 1)
                if end < 0:
                    return close
                if end > close:
                    at = end + 1
                    break
                equals = page.find("=", end + 1, close)
            else:
                equals = page.find("=", k, close)
        else:
            return close


def tokens(page: str, w: Weights, made: list[Around] | None = None) -> Iterator[Token]:
    """Tags and runs of words of a page in order, with what is open around them. Scripts, styles and other raw
    elements make no words. Broken markup never fails: what is not closed ends with the page. One pass: what a search
    to the page's end has not found is not looked for again. Open elements are added to made, outer ones first."""
    size, at, block = len(page), 0, 0
    top: Around | None = None
    open_names: Counter[str] = Counter()
    missing: set[str] = set()  # ends that the rest of the page does not have
    low = page.lower()
    if len(low) != size:  # letters whose small form is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = low.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while at < size:
        begin = page.find("<", at)
        if begin != at:
            end = size if begin < 0 else begin
            yield Token(None, (), page[at:end], block, top)
            at = end
            continue
        follow = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        closing = follow == "/"
        m = _NAME.match(page, at + 1 + closing)
        if m is None:
            if follow in ("!", "?") or closing:
                end = find(">", at)
                at = size if end < 0 else end + 1
            else:
                yield Token(None, (), "<", block, top)
                at += 1
            continue
        name = m[0].lower()
        if ">" in missing:
            return  # a tag that the page's end cut off
        end = _tag_end(page, m.end(), size)
        if end < 0:
            missing.add(">")
            return
        inside = page[m.end() : end]
        at = end + 1
        if name not in _INLINE and name != "br":
            block += 1
        if closing:
            if not open_names[name]:
                continue
            while top is not None:
                gone, top = top, top.outer
                open_names[gone.name] -= 1
                if gone.name == name:
                    yield Token(name, gone.keys, "", block, top)
                    break
            continue
        names = [x for g in _NAMES.findall(inside) for x in "".join(g).lower().split()] if "=" in inside else []
        keys = (name, *(f"{name}.{x}" for x in names))
        if name in _RAW:
            end = find(f"</{name}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = size if end < 0 else (close + 1 if close >= 0 else size)
            yield Token(name, keys, "", block, top)
            continue
        yield Token(name, keys, " " if name == "br" else "", block, top)
        if name in _VOID or inside.endswith("/"):
            continue
        if name in _CLOSES_P or name == "li":
            # An open paragraph or item ends where the next begins, if nothing but inline elements lies between.
            ends, inner = "li" if name == "li" else "p", top.anchor if top is not None else None
            if inner is not None and inner.name == ends:
                while top is not inner:
                    open_names[top.name] -= 1
                    top = top.outer
                open_names[ends] -= 1
                top = inner.outer
        top = Around(top, name, keys, names, w)
        open_names[name] += 1
        if made is not None:
            made.append(top)


def learn(pages: list[str]) -> Weights:
    """Weights from pages that mark their main region; without such pages the built-in ones of score() hold.

    Main text is what stands in the region outside elements that never are text, and outside containers whose name
    alone speaks against them, which teach nothing.
    """
    word, tag = (Counter(), Counter()), (Counter(), Counter())
    by_name: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    pages_with: Counter[str] = Counter()
    used, none = 0, Weights()
    for page in pages:
        made: list[Around] = []
        ts = list(tokens(page, none, made))
        if not any(t.tag in _MAIN for t in ts):
            continue
        used += 1
        for t in ts:
            a = t.around
            if t.tag is not None:
                for k in t.keys:
                    tag[int(a is not None and a.main and not a.never)][k] += 1
            elif a is not None and not a.apart:
                a.counts[int(a.main and not a.never)] += len(t.text.split())
        # Innermost first, so that an element's words are all of those inside it.
        for a in reversed(made):
            for k in a.keys:
                for side in (0, 1):
                    word[side][k] += a.counts[side]
                    by_name[side][k.partition(".")[2]] += a.counts[side]
            if a.outer is not None:
                a.outer.counts[0] += a.counts[0]
                a.outer.counts[1] += a.counts[1]
        pages_with.update({k.partition(".")[2] for a in made for k in a.keys})
    if not used:
        return none
    odds = lambda c, k: math.log((c[1][k] + 1) / (c[0][k] + 1))
    cut = lambda x, low, high: max(low, min(high, x))
    words = {k: cut(odds(word, k), -MOST, MOST) for k in {*word[0], *word[1]}}
    apart = frozenset(x for x, n in pages_with.items() if x and n >= LEAST_PAGES and odds(by_name, x) <= APART)
    return Weights(words, {k: cut(odds(tag, k) - 2, -8, -0.05) for k in {*tag[0], *tag[1]}}, apart, True)


def score(t: Token, w: Weights) -> float:
    """Score of a token: words by the elements around them, positive unless these speak against; tags negative."""
    a = t.around
    main = a is not None and a.main
    if t.tag is None:
        n = len(t.text.split())
        if a is not None and (a.never or a.apart):
            return 0.0 if main else -2.0 * n
        total = a.weight if a is not None else 0.0
        if main:
            return n * max(KEPT, min(2.0, total))
        return n * (max(-2.0, min(2.0, total)) if w.known and total else 0.5 if w.known else 1.0)
    known = [w.tag[k] for k in t.keys if k in w.tag]
    cost = min(known) if known else (-0.5 if t.tag in _INLINE or t.tag in ("p", "br", "li", "h1", "h2", "h3", "h4") else -3.0)
    return max(cost, TAG_INSIDE) if main and t.tag not in _MAIN else cost


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the greatest sum (the first of equals); empty if none is positive."""
    best, total, begin, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def main_text(page: str | None, w: Weights) -> str:
    """The page's main text: blocks of the best region, white space made single, joined by an empty line."""
    ts = list(tokens(page or "", w))
    begin, end = best_region([score(t, w) for t in ts])
    blocks: list[str] = []
    now: list[str] = []
    last = None
    for t in ts[begin:end]:
        if t.block != last:
            blocks.append("".join(now))
            now, last = [], t.block
        if t.text and not (t.around is not None and (t.around.never or t.around.apart)):
            now.append(t.text)
    blocks.append("".join(now))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def train(pages: DataFrame, html: str = "html", key: str = "page_id", most: int = TRAIN_PAGES) -> Weights:
    """Weights from at most `most` pages with an article or main element, those with the least hashes of their key.

    Chosen pages are read whole, on the driver."""
    html_col, h = F.col(html).cast("string"), F.xxhash64(F.col(key).cast("string"))
    marked = pages.where(html_col.rlike("(?i)<(article|main)[\\s>]"))
    # Keys first, so that no task sends pages that are not chosen.
    chosen = [r.h for r in marked.select(h.alias("h")).distinct().orderBy("h").limit(most).collect()]  # at most `most` rows
    if not chosen:
        return Weights()
    texts = marked.where(h.isin(chosen)).groupBy(h.alias("h")).agg(F.min(html_col).alias("t"))
    return learn(sorted(r.t for r in texts.collect()))  # at most `most` rows


def extract(pages: DataFrame, weights: Weights, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text and its length in code points, n_chars (columns of those names are replaced).

    Null or empty html, and pages without main text, give an empty text. Whole pages are read, nothing is capped.
    Every page is read by itself: repeated rows get equal results; other columns stay.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = shared.value
        for column in columns:
            yield pa.array([main_text(x.as_py(), w) for x in column], pa.string())

    own = free_name(pages, "text")
    out = pages.withColumn(own, run(F.col(html).cast("string")))
    return out.withColumns({into: F.col(own), "n_chars": F.length(own).cast("long")}).drop(own)
