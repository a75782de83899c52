"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of tokens: words and tags. Words score positive, tags negative; words inside elements that usually
hold no content (by tag name and by the words of class, id and role) score negative too. The contiguous run of
tokens with the greatest sum is the content; one linear scan finds it. All scores are log-odds counted on labelled
pages (`examples`), a small table made by a fixed rule from layouts of marked blocks.

A run inside a container of content (an article) stands for all content of that container, so that a short heading
or last line is not lost to the tags around it; a run outside of any grows over words that are outside too. Words
with a negative score inside (an advert within the article) are left out. References are decoded, white space inside a block becomes one space, blocks are joined by one space.

Unclosed and wrongly closed tags, unclosed comments and pages cut off anywhere are read as far as they go. A null or
empty page, and one without words, has an empty text. Of runs with equal sums the first is taken. Rows are read one by
one, so repeated rows repeat results; they travel as a struct, so their columns cannot clash.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.llm.common import slices, texts_of

# Fixed lists of HTML: elements without an end, elements whose content is not text, elements that break a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style template noscript iframe textarea title"  # these run to the end of the page if they are not closed
CLOSED = "object svg math select canvas audio video"
CLOSED_NAMES = frozenset(CLOSED.split())
BLOCKS = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    optgroup option p pre section summary table tbody td tfoot th thead title tr ul""".split())
# Opening one of these ends an open paragraph.
ENDS_P = BLOCKS - {"br", "button", "body", "html", "head", "option", "optgroup", "td", "th", "tr", "tbody", "title", "caption"}

_tag = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
# A tag whose quotes do not end is read up to the next end of a tag.
_broken_tag = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>[^>]*+)>")
_other = re.compile(r"<!--.*?(?:-->|\Z)|<[/!?a-zA-Z][^>]*+(?:>|\Z)|[^<]++|<", re.DOTALL)
_ends = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in f"{RAW} {CLOSED}".split()}
_attribute = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_name_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements that set a part of a page apart; others never decide, whatever the counts say.
PARTS = frozenset("""address article aside button center details dialog div fieldset figure footer form header label
    legend main menu nav section""".split())

# Inside content these need no more than one word of a class to be something else, and words that name adverts are
# enough on any element. Headings, paragraphs, cells and inline elements need two words.
LISTS = frozenset("dl ol table ul".split())
ADVERTS = frozenset(".ad .ads .adsense .advert .advertisement .advertising .sponsor .sponsored".split())

# An element is decisive for the words in it if its log-odds reach this.
DECISIVE = 0.7
# Log-odds of a feature count this much at most, so that one word of a class can outweigh another.
LIMIT = 3.0


@dataclass
class Weights:
    """Log-odds of element features, and the scores of a tag and of words by the sign of their container."""

    features: dict[str, float]
    tag: float
    words: dict[int, float]


def _features(name: str, attributes: str, inside: bool) -> list[str]:
    found = [f"{name}+" if inside and name in ("header", "section", "div") else name]
    if attributes:
        for m in _attribute.finditer(attributes):
            found += {f".{part.lower()}" for part in _name_part.findall(m[1] or m[2] or m[3] or "")}
    return found


@dataclass
class Run:
    """A text between two tags: its container (number and sign) and the block it belongs to."""

    text: str
    words: int
    container: int
    sign: int
    block: int
    marked: bool


def pieces(page: str) -> Iterator[re.Match | str | None]:
    """Tags, texts, and None for all that is neither, in order. Every character is read a bounded number of times: the end
    of an element is searched again only after it was found, and so are the ends of quotes."""
    at, unclosed, quotes = 0, set(), True
    while at < len(page):
        found = None
        if page[at] == "<" and page[at + 1 : at + 2] not in ("!", "?"):
            found = _tag.match(page, at) if quotes else _broken_tag.match(page, at)
            if found is None and quotes:
                found = _broken_tag.match(page, at)
                quotes = found is None
        if found is None:
            found = _other.match(page, at)
            text = found[0]
            yield None if text[0] == "<" and len(text) > 1 else text
            at = found.end()
            continue
        at, name = found.end(), found["name"].lower()
        if name in _ends and not found["close"] and not found["attributes"].endswith("/") and name not in unclosed:
            end = _ends[name].search(page, at)
            if end or name not in CLOSED_NAMES:
                at = end.end() if end else len(page)
                yield None
                continue
            unclosed.add(name)
        yield found


def _set_apart(name: str, own: list[str], features: dict[str, float]) -> bool:
    """Whether an element inside content is a part of its own, given that its features are against it."""
    if name in PARTS or not ADVERTS.isdisjoint(own):
        return True
    words = sum(features.get(feature, 0.0) for feature in own[1:])
    return words <= -DECISIVE if name in LISTS else words <= -1.5 * LIMIT


def tokens(page: str, features: dict[str, float], seen: Counter | None = None) -> list[Run | None]:
    """Runs of text and tags (None) in order. ``seen`` counts words by element feature and mark, for learning."""
    out: list[Run | None] = []
    open_names: Counter[str] = Counter()
    stack: list[tuple[str, int, int, bool, tuple[str, ...]]] = [("", 0, 0, False, ())]
    block = number = 0

    def pop(name: str) -> None:
        while len(stack) > 1:
            last = stack.pop()
            open_names[last[0]] -= 1
            if last[0] == name:
                return

    for piece in pieces(page):
        if piece is None:
            out.append(None)
            continue
        if isinstance(piece, str):
            text = html.unescape(piece)
            words = len(text.split())
            _, container, sign, _, ancestors = stack[-1]
            marked = open_names["mark"] > 0
            out.append(Run(text, words, container, sign, block, marked))
            if seen is not None and words:
                for feature in set(ancestors):
                    seen[feature, marked] += words
                seen["", marked] += words
            continue
        name, attributes = piece["name"].lower(), piece["attributes"]
        if name != "mark":
            out.append(None)
        block += name in BLOCKS
        if piece["close"]:
            if open_names[name]:
                pop(name)
            continue
        if name in ENDS_P and open_names["p"]:
            pop("p")
        if name == "li" and open_names["li"] and stack[-1][0] == "li":
            pop("li")
        if name in VOID or attributes.endswith("/"):
            continue
        _, container, sign, inside, ancestors = stack[-1]
        own = _features(name, attributes, inside)
        score = sum(features.get(feature, 0.0) for feature in own) if name in PARTS or len(own) > 1 else 0.0
        # Content within content is the same container; only an article comes back inside of other things.
        if score >= DECISIVE and (sign == 0 or sign < 0 and name in ("article", "main")):
            number += 1
            container, sign = number, 1
        elif score <= -DECISIVE and (sign == 0 and name not in ("html", "body") or sign > 0 and _set_apart(name, own, features)):
            number += 1
            container, sign = number, -1
        open_names[name] += 1
        stack.append((name, container, sign, inside or name in ("article", "main"),
                      (*ancestors, *own) if seen is not None else ()))
    return out


def content(page: str | None, weights: Weights) -> str:
    """The text of the best run of a page."""
    if not page:
        return ""
    row = tokens(page, weights.features)
    best = total = 0.0
    start = first = last = -1
    for at, token in enumerate(row):
        if total <= 0:
            total, start = 0.0, at
        total += weights.tag if token is None else token.words * weights.words[token.sign]
        if total > best:
            best, first, last = total, start, at
    if first < 0:
        return ""
    own = {t.container for t in row[first : last + 1] if t is not None and t.words and t.sign >= 0}

    def near(token: Run | None) -> bool:
        return token is None or not token.words or not token.container

    while 0 in own and first > 0 and near(row[first - 1]):
        first -= 1
    while 0 in own and last + 1 < len(row) and near(row[last + 1]):
        last += 1
    blocks: dict[int, list[str]] = {}
    for at, token in enumerate(row):
        if token is not None and token.sign >= 0 and token.container in own and (
                token.container or first <= at <= last):
            blocks.setdefault(token.block, []).append(token.text)
    return " ".join(part for part in (" ".join("".join(texts).split()) for texts in blocks.values()) if part)


# Layouts of the labelled table. @ is a block of content, # a block without; both become a few random words.
# Content is wrapped in <mark>, which is how a label reads; the marks are not features.
LAYOUTS = (
    '<head><title>#</title></head><body><nav><ul><li><a>#</a></li><li><a>#</a></li></ul></nav><div class="ad">#</div>'
    "<article><h1>@</h1><p>@</p><p>@</p><p><b>@</b>@</p></article><footer>#</footer></body>",
    '<body><header><a>#</a><p>#</p></header><main><article><header><h1>@</h1></header><p>@</p><ul><li>@</li><li>@</li>'
    '</ul><p>@</p><aside>#</aside><p>@</p><div class="share social">#</div></article></main>'
    '<aside class="sidebar"><h2>#</h2><p>#</p><p>#</p></aside><footer><p>#</p></footer></body>',
    '<body><div id="header"><h1>#</h1></div><div id="menu"><a>#</a><a>#</a></div><div id="content"><h1>@</h1><p>@</p>'
    '<p>@</p><table><tr><td>@</td><td>@</td></tr></table></div><div id="sidebar">#</div><div id="footer">#</div></body>',
    '<body><div class="cookie notice">#<button>#</button></div><div class="page"><div class="post-content"><h2>@</h2>'
    '<p>@</p><blockquote>@</blockquote><div class="advert banner sponsored">#</div><p>@</p></div>'
    '<div class="comments" id="comments"><h3>#</h3><div class="comment"><p>#</p></div><div class="comment"><p>#</p></div>'
    '</div></div><form><label>#</label><p>#</p></form></body>',
    '<body><div class="breadcrumb">#</div><section class="article-body main story entry text"><h1>@</h1><p>@</p><p>@</p>'
    '<div class="related recommended">#</div><p>@</p><div class="newsletter signup subscribe">#<form>#</form></div></section>'
    '<section class="comments reply replies discussion respond"><p>#</p><p>#</p></section>'
    '<div class="popup modal consent alert promo">#</div></body>',
    '<body><p>@</p><p>@</p><p>@</p></body>',
    '<body><nav>#</nav><div><h1>@</h1><p>@</p><p>@</p><pre>@</pre></div><footer>#</footer></body>',
    '<body><div class="top nav navigation toolbar">#</div><div role="main"><h1>@</h1><div><p>@</p></div><div><p>@</p></div>'
    '<figure><figcaption>@</figcaption></figure></div><div role="complementary" class="widget">#</div>'
    '<div role="banner">#</div><div role="contentinfo" class="copyright legal">#</div><div role="navigation">#</div>'
    '<div class="search login tags pagination ads sponsor adsense advertisement notification warning disclaimer">#</div>'
    '<div class="side rail links menu footer header masthead skip">#</div></body>',
    '<body><div class="hdr site-header topbar">#</div><article><h1>@</h1><p>@</p><p>@</p></article><div id="disqus_thread">#</div>'
    '<div id="gdpr" class="privacy cookies overlay">#</div><div class="ftr site-footer bottom">#</div></body>',
    '<body><article class="post"><h1>@</h1><div class="byline meta">#</div><div class="body"><p>@</p><section><h2>@</h2>'
    '<p>@</p></section><section><div>@</div></section></div><footer>#</footer></article></body>',
)


def examples(copies: int = 6, seed: int = 2) -> list[str]:
    """The labelled table: pages with content in marks."""
    draw = random.Random(seed)

    def words(least: int, most: int) -> str:
        return " ".join("w" * draw.randrange(1, 9) for _ in range(draw.randrange(least, most)))

    return ["<html>" + re.sub(r"[@#]", lambda m: f"<mark>{words(8, 60)}</mark>" if m[0] == "@" else words(1, 12), layout)
            + "</html>" for layout in LAYOUTS for _ in range(copies)]


def learn(pages: list[str] | None = None) -> Weights:
    """Counts on labelled pages: words by element feature, then tokens by the sign of their container."""
    pages = examples() if pages is None else pages
    seen: Counter = Counter()
    for page in pages:
        tokens(page, {}, seen)
    good, bad = seen["", True], seen["", False]
    names = {name for name, _ in seen if name and name != "mark"}
    # Shares of all content words and of all other words; half a word each keeps unseen sides finite.
    odds = {name: math.log((seen[name, True] + 0.5) / (good + 1)) - math.log((seen[name, False] + 0.5) / (bad + 1))
            for name in names if name not in ("html", "body")}
    features = {name: max(-LIMIT, min(LIMIT, value)) for name, value in odds.items()}
    kinds: Counter = Counter()
    for page in pages:
        row = tokens(page, features)
        known = [t.marked for t in row if t is not None and t.words]
        if not known:
            continue
        ends = [i for i, t in enumerate(row) if t is not None and t.words and t.marked]
        for at, token in enumerate(row):
            inside = ends and ends[0] <= at <= ends[-1]
            if token is None:
                kinds["tag", bool(inside)] += 1
            elif token.words:
                kinds[token.sign, token.marked] += token.words
    inside, outside = (sum(n for (_, side), n in kinds.items() if side is s) for s in (True, False))
    odds = {kind: math.log((kinds[kind, True] + 0.5) / (inside + 1)) - math.log((kinds[kind, False] + 0.5) / (outside + 1))
            for kind in ("tag", -1, 0, 1)}
    return Weights(features, min(-0.1, odds["tag"]), {-1: min(-0.1, odds[-1]), 0: max(0.1, odds[0]), 1: max(0.1, odds[1])})


def extract(pages: DataFrame, page: str = "html", weights: Weights | None = None) -> DataFrame:
    """Every row without its page as ``row``, and the page's main text as ``text``."""
    weights = learn() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "page"):
                found = pa.array([content(p, weights) for p in texts_of(part, "page")], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), found], ["row", "text"])

    others = [c for c in pages.columns if c != page]
    rows = pages.select(F.struct(*others).alias("row"), F.col(page).alias("page"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
