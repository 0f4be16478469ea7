"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

A page becomes a sequence of tags and words. A word is worth how likely words of its context (the block it stands in, and
whether it is a link) lie in the article of pages that mark theirs; a tag costs how likely it lies outside. Class words
of elements are weighed the same way, and an element of a class that lies outside is left out. One linear scan finds the
run of the highest sum, and its blocks are the text.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import append_columns, batch_of, ddl, quoted, table

#: Features are hashed to so many weights (1 MB), whatever the number of pages.
SLOTS = 1 << 17
#: Words that the starting weight of a context or tag, and of a class word, is worth.
WORTH, CLASS_WORTH = 10.0, 100.0
#: What tags that stand together cost at most, in words of the page's likeliest contexts, which hold one word in so many.
BOUNDARY, COMMON = 0.8, 8
#: Log odds from which on a class word tells that its element is outside.
OUTSIDE = -1.0

# Fixed values of HTML: element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
EMBEDDED = frozenset("svg canvas object audio video select button".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
    "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mtable mtr mtd semantics annotation".split()
)
SKIPPED = frozenset("nav footer aside head".split())
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "option": ("option", "select"), "body": ("head", "html"),
}
#: A start for class words before any page is seen: a class whose words are all among these is likelier outside. Chosen by
#: hand, and outweighed by what the pages show.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer sidebar sidebars cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login share sharing related "
    "recommended trending pagination contentinfo complementary copyright".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies disqus".split())
#: Words that say nothing beside those.
FILLER = frozenset("area bar block box buttons container inner items link links list outer section wrap wrapper".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_VALUES = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.IGNORECASE)
_STYLED = re.compile(r"""(?:^|\s)style\s*=\s*("[^"]*"|'[^']*')""", re.IGNORECASE)
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) or ("end", name, ""), in order and in time linear in the page.

    Comments, declarations, and the contents of raw elements are left out. A quote counts only after an equals sign, and
    only if it is closed; a tag that never ends takes the rest of the page, as in browsers.
    """
    at, size, lower, none = 0, len(page), None, set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield "text", page[at:lt], ""
        if lt == size:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        named = _NAME.match(page, lt)
        if not named:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        end = named.end()
        while stop := _STOP.search(page, end):
            end = stop.end()
            if stop[0] == ">":
                break
            before = stop.start() - 1
            while before > lt and page[before].isspace():
                before -= 1
            if page[before] == "=" and stop[0] not in none:
                closed = page.find(stop[0], end)
                if closed < 0:
                    none.add(stop[0])  # nor is there one further on
                else:
                    end = closed + 1
        if not stop:
            return
        name = named[1].lower()
        at = end
        if page[lt + 1] == "/":
            yield "end", name, ""
        elif name in RAW:
            lower = lower or page.lower()
            # lower() can lengthen a few letters; then positions are found in the page itself
            found = re.compile(f"</{name}", re.IGNORECASE).search(page, at) if len(lower) != size else None
            close = (found.start() if found else -1) if len(lower) != size else lower.find(f"</{name}", at)
            close = page.find(">", close) if close >= 0 else -1
            at = size if close < 0 else close + 1
        else:
            yield "start", name, page[named.end() : end - 1]


@dataclass(slots=True)
class Piece:
    """A tag, or the text up to the next tag with its number of words."""

    feature: str
    words: int
    inside: bool
    main: bool
    skip: bool
    form: int
    breaks: bool
    text: str


@dataclass(slots=True)
class Open:
    """An open element and what holds inside it."""

    name: str
    block: str
    link: bool
    inside: bool
    main: bool
    skip: bool
    drop: bool  # not even its tags count
    form: int
    names: tuple[str, ...]
    words: tuple[int, int] = (0, 0)


@dataclass
class Page:
    pieces: list[Piece] = field(default_factory=list)
    #: Class words with their elements' words inside and outside the article.
    classes: list[tuple[str, int, int]] = field(default_factory=list)
    #: Forms that hold an article or main element.
    wrappers: set[int] = field(default_factory=set)

    def whole_forms(self) -> set[int]:
        """Forms that wrap the page: they hold the article, or half of all words."""
        words, total = {}, 0
        for p in self.pieces:
            if not p.skip:
                total += p.words
                if p.form:
                    words[p.form] = words.get(p.form, 0) + p.words
        return self.wrappers | {k for k, n in words.items() if 2 * n >= total}


def _names(name: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """The class words of a start tag, and whether it is hidden."""
    if not attributes or name in ("html", "body", "main"):
        return (), False
    hidden = "idden" in attributes.lower() and bool(_HIDDEN.search(_VALUES.sub("=", attributes)))
    hidden = hidden or any(_NONE.search(x) for x in _STYLED.findall(attributes))
    return tuple(dict.fromkeys(w for x in _NAMED.findall(attributes) for w in x.strip("\"'").lower().split())), hidden


def boilerplate_start(token: str, name: str) -> bool:
    """Whether a class word is of those that start as likelier outside."""
    words = set(_WORD.findall(token))
    named = words & COMMENTS if name == "article" else words & (BOILERPLATE | COMMENTS)
    return bool(named) and not words - named - FILLER


def read_page(page: str, weights: Callable[[str, str], bool] = boilerplate_start) -> Page:
    """The page's tags and texts in order. `weights` tells whether an element of a class word is left out."""
    out = Page()
    root = Open("", "", False, False, False, False, False, 0, ())
    stack, places, blocks = [root], {}, [0]  # blocks: the open elements that aren't inline
    inside = outside = forms = 0

    def close(number: int) -> None:
        while len(stack) > number:
            gone = stack.pop()
            places[gone.name].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            out.classes += [(f"{gone.name == 'article' and 'article ' or ''}{x}", inside - gone.words[0], outside - gone.words[1]) for x in gone.names]

    def last(names: str) -> int:
        return max((places[x][-1] for x in names.split() if places.get(x)), default=-1)

    for kind, name, attributes in tokens(page):
        top = stack[-1]
        if kind == "text":
            if top.drop:
                continue
            decoded = html.unescape(name) if "&" in name else name
            words = len(decoded.split())
            if not top.skip:
                inside, outside = (inside + words, outside) if top.inside else (inside, outside + words)
            out.pieces.append(Piece(f"w {top.block} {'a' * top.link}", words, top.inside, top.main, top.skip, top.form, False, decoded if words else " "))
        elif kind == "start":
            if name in CLOSES:
                ended, within = CLOSES[name]
                if (at := last(ended)) > last(within):
                    close(at)
            elif name not in INLINE and name not in VOID and name not in EMBEDDED and stack[blocks[-1]].name == "p":
                close(blocks[-1])
            top = stack[-1]
            if name in VOID:
                if not top.drop:
                    out.pieces.append(Piece(f"t {name}", 0, top.inside, top.main, top.skip, top.form, name == "hr", "" if name == "hr" else " " if name == "br" else ""))
                continue
            names, hidden = _names(name, attributes)
            drop = top.drop or hidden or name in EMBEDDED
            header = name == "header" and not top.inside and not top.main
            skip = top.skip or drop or header or name in SKIPPED or any(weights(x, name) for x in names)
            form = top.form
            if name == "form" and not form:
                forms += 1
                form = forms
            if name in ("article", "main") and form and not skip:
                out.wrappers.add(form)
            block = top.block if name in INLINE else name
            opened = Open(name, block, name == "a" or (top.link and name in INLINE), top.inside or name == "article", top.main or name == "main", skip, drop, form, names, (inside, outside))
            if not drop:
                out.pieces.append(Piece(f"t {name}", 0, opened.inside, opened.main, skip, form, name not in INLINE, ""))
            if not attributes.endswith("/") or name not in EMBEDDED:
                places.setdefault(name, []).append(len(stack))
                if name not in INLINE:
                    blocks.append(len(stack))
                stack.append(opened)
        else:
            if not top.drop:
                out.pieces.append(Piece(f"e {name}", 0, top.inside, top.main, top.skip, top.form, name not in INLINE and name not in VOID, " " if name == "br" else ""))
            at = last(name)
            if at > 0 and (name not in INLINE or at > blocks[-1]):
                close(at)
    close(1)
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run of the highest sum: first, one past the last. Of equal runs the longest first one; none above zero is empty."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += score
        if run > best or (run == best and best > 0 and start == found[0]):
            best, found = run, (start, i + 1)
    return found


class Weights:
    """Learned weights by feature, over what holds before any page is seen."""

    def __init__(self, counts: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.inside, self.outside = counts or (np.zeros(SLOTS, dtype=np.float32), np.zeros(SLOTS, dtype=np.float32))
        self.known: dict[str, float] = {}
        self.left_out: dict[tuple[str, str], bool] = {}

    def worth(self, feature: str) -> float:
        """0 to 1 for a word's context, and 0 to -1 for a tag."""
        found = self.known.get(feature)
        if found is None:
            at = slot(feature)
            seen, start = self.inside[at] + self.outside[at] + WORTH, 0.2 if feature[-1] == "a" and feature[0] == "w" else 0.5
            found = float((self.inside[at] + start * WORTH) / seen) if feature[0] == "w" else -float((self.outside[at] + start * WORTH) / seen)
            if len(self.known) < SLOTS:
                self.known[feature] = found
        return found

    def left_out_by(self, token: str, name: str) -> bool:
        """Whether an element of this class word is boilerplate by the pages that mark their article."""
        found = self.left_out.get((token, name))
        if found is None:
            at = slot(f"n {'article ' * (name == 'article')}{token}")
            start = 0.12 if boilerplate_start(token, name) else 0.5
            odds = (self.inside[at] + start * CLASS_WORTH) / (self.outside[at] + (1 - start) * CLASS_WORTH)
            found = bool(np.log(odds) <= OUTSIDE)
            if len(self.left_out) < SLOTS:
                self.left_out[token, name] = found
        return found


def scores_of(page: Page, weights: Weights) -> list[float]:
    """Each piece's part in a run's sum; only pieces above zero are text.

    Where article elements (else main elements) hold at least half of the words, all words there count one, tags little,
    and words elsewhere count against the run. On other pages contexts and tags count by their weights: a word against the
    likeliest contexts of its page, as pages differ in what they write their text in, and tags that stand together as the
    costliest of them, at most as much as a word, so that short blocks, rows and cells hold together. What is left out
    counts nothing.
    """
    whole = page.whole_forms()
    gone = [p.skip or (p.form and p.form not in whole) for p in page.pieces]
    total = sum(p.words for p, g in zip(page.pieces, gone) if not g)
    for marked in ("inside", "main"):
        held = sum(p.words for p, g in zip(page.pieces, gone) if not g and getattr(p, marked))
        if held and 2 * held >= total:
            return [0.0 if g else (p.words if getattr(p, marked) else -p.words) if p.feature[0] == "w" else -0.001 for p, g in zip(page.pieces, gone)]
    top, held = 1.0, 0
    for worth, words in sorted(((weights.worth(p.feature), p.words) for p, g in zip(page.pieces, gone) if not g and p.words), reverse=True):
        top, held = worth, held + words
        if COMMON * held >= total:
            break
    out, first = [0.0] * len(page.pieces), -1
    for i, (p, g) in enumerate(zip(page.pieces, gone)):
        if g:
            continue
        if p.feature[0] == "w":
            out[i] = p.words * min(1.0, weights.worth(p.feature) / top)
            first = -1 if p.words else first
        elif first < 0:
            first, out[i] = i, max(weights.worth(p.feature), -1.0) * BOUNDARY
        else:  # of tags without a word between them the first bears the cost
            out[first] = min(out[first], max(weights.worth(p.feature), -1.0) * BOUNDARY)
    return out


def main_text(body: str | None, weights: Weights | None = None) -> str:
    """The blocks of the best run, white space made one space, joined by blank lines; empty if there is none."""
    if not body:
        return ""
    weights = weights or Weights()
    page = read_page(body, weights.left_out_by)
    scores = scores_of(page, weights)
    lo, hi = best_run(scores)
    blocks, block = [], []
    for p, score in zip(page.pieces[lo:hi], scores[lo:hi]):
        if p.breaks:
            blocks.append(block)
            block = []
        elif p.text and not p.skip and (score > 0 or not p.words):
            block.append(p.text)
    joined = (" ".join("".join(x).split()) for x in [*blocks, block])
    return "\n\n".join(x for x in joined if x)


def learn_weights(pages: DataFrame, page: str = "html") -> Weights:
    """How often each feature lies inside and outside the article, over every page that has an article element."""
    schema = {"slot": "int", "inside": "bigint", "outside": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SLOTS), dtype=np.int64)
        slots: dict[str, int] = {}
        for batch in batches:
            for body in batch.column(0).to_pylist():
                found = read_page(body, lambda *_: False)
                whole = found.whole_forms()
                for p in found.pieces:
                    if not p.skip and (not p.form or p.form in whole):
                        at = slots.get(p.feature)
                        if at is None:
                            at = slot(p.feature)
                            if len(slots) < SLOTS:
                                slots[p.feature] = at
                        counts[0 if p.inside else 1, at] += p.words if p.feature[0] == "w" else 1
                for token, inside, outside in found.classes:
                    at = slot(f"n {token}")
                    counts[0, at] += inside
                    counts[1, at] += outside
        at = np.flatnonzero(counts.any(axis=0))
        yield batch_of(schema, [at.astype(np.int32), counts[0, at], counts[1, at]])

    labelled = pages.select(F.col(quoted(page)).alias("page")).where(F.lower("page").contains("<article"))
    found = labelled.mapInArrow(run, ddl(schema)).groupBy("slot").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = found.toArrow()  # at most SLOTS rows
    inside, outside = np.zeros(SLOTS, dtype=np.float32), np.zeros(SLOTS, dtype=np.float32)
    at = rows["slot"].to_numpy()
    inside[at], outside[at] = rows["inside"].to_numpy(), rows["outside"].to_numpy()
    return Weights((inside, outside))


def extract_text(pages: DataFrame, page: str = "html", weights: Weights | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """`pages` with text and n_chars of each page's main text.

    Null, empty and wordless pages give the empty text. Weights are learned from `pages` where none are given; without
    any labelled page, words count a half and tags cost a half. Of equally good runs the first is taken. Pages of any
    length are read whole, in time that grows with their length. Repeated rows each get their row; an empty table gives an
    empty one; columns of `pages` called text or n_chars are replaced.
    """
    weights = learn_weights(pages, page) if weights is None else weights
    sent = pages.sparkSession.sparkContext.broadcast((weights.inside, weights.outside))  # SLOTS numbers each

    def make() -> Callable:
        own = Weights(sent.value)

        def compute(bodies):
            texts = [main_text(bodies[i].as_py(), own) for i in range(len(bodies))]
            return texts, [len(x) for x in texts]

        return compute

    return append_columns(pages, [page], {"text": "string", "n_chars": "bigint"}, make, drop=drop)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), drop=("html",))
