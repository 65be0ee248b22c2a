"""Operator 8: the main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; how much
is learned from labelled pages, those whose markup names the content (an article or main
element). There words in the content element score positive and words beside it negative;
a tag's score is the log odds of standing in the content rather than beside it, and so are
those of a mark, a name in an element's class, id or role, and of each part of one. A block
whose words are mostly links scores by what such blocks do on labelled pages. One linear scan finds the
contiguous run with the highest sum, its ends widen to whole blocks, and the words in it
that score positive are the text.

On a page whose markup names no content, every word scores positive until its element's
marks say otherwise, and tags by what was learned. Elements that HTML itself defines as
no content (menus, forms, scripts, hidden ones, ...) and those whose marks outweigh a word
stand outside the sequence. A mark counts against an element by its parts: those that name
page furniture (and parts that labelled pages show beside the content), unless the mark also has
a part that is neither that nor a word for layout, people or pages (``reader-comments`` and ``cookie-banner`` do, ``search-algorithms`` doesn't).
Three or more neighbouring blocks that are links alone are a list of links, not text, also inside the content.

Defined cases: null and empty pages, and pages without words, give an empty text; an
unclosed element ends where HTML implies its end tag (a paragraph at the next block, an
item or cell at the next one), else with its container; repeated rows stay; without labelled pages the
default weights hold; an empty table gives an empty result; other columns of the input
are ignored but for those named to keep, which may have any name but text and n_chars.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checked_keep, string_list

# Names of HTML elements by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
ASIDE = frozenset("aside button canvas datalist dialog embed footer form head header iframe input label map menu nav noscript object option select svg template textarea".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that bound the reach of an end tag, and blocks that a search for an open item passes.
SCOPE = ("caption", "html", "object", "table", "td", "template", "th")
SPECIAL = BLOCKS | {"button", "object", "select", "template"}
LOOSE = ("address", "div", "p")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
_ROWS, _CELLS = ("tbody", "thead", "tfoot"), ("caption", "td", "th")
#: By start tag: the open elements it ends, and the elements that keep those beyond them open.
ENDS = {
    **{x: (("td", "th"), ("table", "tr")) for x in ("td", "th")},
    "tr": (("tr", *_CELLS), ("table", *_ROWS)),
    **{x: ((*_ROWS, "tr", *_CELLS), ("table",)) for x in _ROWS},
    "option": (("option",), ("datalist", "optgroup", "select")),
    "optgroup": (("optgroup", "option"), ("select",)),
}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CONTENT = ("article", "main")
# Parts of the names that pages give to their furniture, and parts that only say where or how it is laid out.
FURNITURE = frozenset("ad ads advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion discussions disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices overlay popup promo promos promotion recommendations recommended related replies reply respond response responses search share sharing sidebar sidebars social sponsor sponsored subscribe trending widget widgets".split())
LAYOUT = frozenset("area article articles bar block blog body bottom box button buttons col column container content entry feed form global group icons inner item items latest left link links list main more news of outer page panel popular post posts primary reader readers right row secondary section signup site slot stories story the thread threads tools top unit user users visitor wrap wrapper you".split())
#: An attribute as HTML reads it: a quote after "=" opens a value of any length; one that never closes is a plain character, so its tag ends at the next ">".
_ATTRIBUTE = r"(?P<key>[^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"(?P<double>[^\"]*+)\"|'(?P<single>[^']*+)'|(?P<bare>[^\s>\"'][^\s>]*+)|(?=>)))?+"
ATTRIBUTE = re.compile(_ATTRIBUTE)
#: Each character is read a bounded number of times: a tag or declaration goes to its ">" or, without one, takes the rest of the page.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|xmp|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[\s/]++|{_ATTRIBUTE})*+)(?P<end>>?)|<[/!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
INVISIBLE = re.compile(r"display\s*:\s*none", re.I)


@dataclass(frozen=True)
class RegionWeights:
    """Score of a word, of a tag by its name (whether it opens or closes), of a mark and of a mark's part; ``other`` for tags that aren't known; ``linked``: of a word in a block of links."""

    word: float = 1.0
    other: float = -1.0
    tags: dict[str, float] = field(default_factory=dict)
    marks: dict[str, float] = field(default_factory=dict)
    parts: dict[str, float] = field(default_factory=dict)
    linked: float = -1.0

    def of_marks(self, marks: list[str]) -> float:
        return sum(self.marks[m] if m in self.marks else prior_odds(m) + self.of_parts(m) for m in marks)

    def of_parts(self, mark: str) -> float:
        """What labelled pages say of the parts of a mark that they don't hold itself; nothing if a part is neither known there nor furniture or layout."""
        parts = parts_of(mark)
        return sum(self.parts.get(p, 0.0) for p in parts) if all(p in self.parts or p in FURNITURE or p in LAYOUT for p in parts) else 0.0


@lru_cache(maxsize=1 << 16)
def parts_of(mark: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(p for p in re.split(r"[^a-z]+", mark) if p))


def marks_of(attrs: dict[str, str]) -> list[str]:
    """The names in class, id and role, in lower case, words of camel case apart, each run of digits as #."""
    names = " ".join(attrs[k] for k in ("class", "id", "role") if k in attrs).split()
    return list(dict.fromkeys(re.sub(r"\d+", "#", re.sub(r"([a-z])([A-Z])", r"\1-\2", n)).lower() for n in names))


@lru_cache(maxsize=1 << 16)
def prior_odds(mark: str) -> float:
    """Log odds of a mark that no labelled page holds: against content if all its parts are furniture or layout, one of them furniture."""
    parts = parts_of(mark)
    return -4.0 if FURNITURE.intersection(parts) and FURNITURE.union(LAYOUT).issuperset(parts) else 0.0


def _attributes(attrs: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault(m["key"].lower(), m["double"] or m["single"] or m["bare"] or "")
    return found


def _is_hidden(attrs: dict[str, str]) -> bool:
    return bool("hidden" in attrs or INVISIBLE.search(attrs.get("style", "")) or attrs.get("aria-hidden", "").strip().lower() == "true")


class OpenElements:
    """The open elements by HTML's rules for end tags left out; a look costs a few ends of lists, whatever the depth."""

    def __init__(self):
        self.names: list[str] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.special: list[int] = []
        self.firm: list[int] = []  # special but for LOOSE

    def _last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    def push(self, name: str) -> None:
        for places in (self.at[name], *([self.special] if name in SPECIAL else []), *([self.firm] if name in SPECIAL and name not in LOOSE else [])):
            places.append(len(self.names))
        self.names.append(name)

    def cut(self, depth: int) -> None:
        while len(self.names) > depth:
            self.at[self.names.pop()].pop()
        for places in (self.special, self.firm):
            while places and places[-1] >= depth:
                places.pop()

    def start(self, name: str) -> None:
        """End what the start tag ends."""
        same = ("li",) if name == "li" else ("dd", "dt") if name in ("dd", "dt") else ()
        if same and self.firm and self.names[self.firm[-1]] in same:
            self.cut(self.firm[-1])
        if name in ENDS:
            ended, until = ENDS[name]
            bound = self._last(until)
            found = [self.at[n][i] for n in ended if (i := bisect_right(self.at[n], bound)) < len(self.at[n])]
            if found:
                self.cut(min(found))
        if name in ENDS_P and self.at["p"] and self.at["p"][-1] > self._last((*SCOPE, "button")):
            self.cut(self.at["p"][-1])

    def end(self, name: str) -> None:
        """End the element that the end tag names and all within, if it is in reach."""
        found = self._last(HEADINGS if name in HEADINGS else (name,))
        if found < 0:
            return
        if name in CONTENT or name in ("body", "html", "table") or name in ASIDE and name not in BLOCKS:
            bound = -1
        elif name in ENDS:
            bound = self._last(("table",))
        elif name not in BLOCKS:
            bound = self.special[-1] if self.special else -1
        else:
            bound = self._last((*SCOPE, *{"p": ("button",), "li": ("ol", "ul")}.get(name, ())))
        if found > bound:
            self.cut(found)


@dataclass(frozen=True)
class Token:
    """A tag (``words`` -1, ``/name`` closes) or a text with its words; ``place``: 2 in an article, 1 in main alone, 0 elsewhere; whether a tag has marks, and whether a text is within a link."""

    text: str
    words: int
    place: int
    marked: bool = False
    linked: bool = False

    @property
    def name(self) -> str:
        return self.text.lstrip("/")


def parse(page: str, weights: RegionWeights | None = None, seen: list[tuple[str, list[int]]] | None = None) -> list[Token]:
    """Tokens outside set-aside elements; without weights only what HTML defines is set aside.

    ``seen`` gets, for each element with marks, each mark that isn't open already and the
    words in the element by place; an element costs as much however deep it is.
    """
    tokens: list[Token] = []
    elements = OpenElements()
    marked: list[tuple[int, list[str], list[int]]] = []  # open elements with marks: depth, new marks, words so far by place
    held: set[str] = set()
    so_far = [0, 0, 0]

    def close_marked(depth: int) -> None:
        while marked and marked[-1][0] > depth:
            _, own, before = marked.pop()
            held.difference_update(own)
            if seen is not None:
                words = [a - b for a, b in zip(so_far, before)]
                seen.extend((m, words) for m in own)

    skip, depth = "", 0  # the set-aside element and its place among the open ones
    place = lambda: 2 if elements.at["article"] else 1 if elements.at["main"] else 0
    for m in TOKEN.finditer(page):
        name = m["name"]
        if name is not None and m["end"]:
            name = name.lower()
            close, empty = bool(m["close"]), name in VOID or m["attrs"].endswith("/")
            if skip and name in CONTENT and not close and skip not in ("form", "aside"):
                elements.cut(depth)  # the element was never closed
            elif close:
                elements.end(name)
            else:
                elements.start(name)
            close_marked(len(elements.names))
            if skip:
                if len(elements.names) > depth and not (close and name == "body"):
                    if not close and not empty:
                        elements.push(name)
                    continue
                elements.cut(depth)
                tokens.append(Token("/" + skip, -1, place()))
                ended, skip = skip, ""
                if close and name == ended:
                    continue
            if not close and not empty:
                elements.push(name)
                attrs = _attributes(m["attrs"]) if m["attrs"] else {}
                aside = name in ASIDE or name not in ("html", "body", *CONTENT) and _is_hidden(attrs)
                marks = marks_of(attrs) if attrs and name not in ("html", "body", *CONTENT) else []
                if not aside and marks and weights is not None:
                    aside = weights.word + weights.of_marks(marks) < 0
                if aside:
                    skip, depth = name, len(elements.names) - 1
                    tokens.append(Token(name, -1, place()))
                    continue
                if marks and seen is not None and (new := [x for x in marks if x not in held]):
                    marked.append((len(elements.names), new, list(so_far)))
                    held.update(new)
            tokens.append(Token("/" + name if close else name, -1, place(), not close and not empty and bool(marks)))
        elif (m["text"] is not None or name is not None) and not skip:  # a tag that never ends is text
            text = _html.unescape(m[0])
            tokens.append(Token(text, len(text.split()), place(), linked=bool(elements.at["a"])))
            so_far[place()] += tokens[-1].words
    close_marked(-1)
    return tokens


def linked_blocks(tokens: list[Token], share: float = 0.5) -> list[bool]:
    """For each token whether it is text of a block whose words are links for more than ``share`` of them."""
    out, start = [False] * len(tokens), 0
    for i, t in enumerate([*tokens, None]):
        if t is None or t.words < 0 and t.name in BLOCKS:
            words = sum(x.words for x in tokens[start:i] if x.words > 0)
            if words and sum(x.words for x in tokens[start:i] if x.words > 0 and x.linked) > share * words:
                out[start:i] = [x.words > 0 for x in tokens[start:i]]
            start = i + 1
    return out


def link_lists(tokens: list[Token], least: int = 3) -> list[bool]:
    """For each token whether it is text of one of ``least`` or more neighbouring blocks that are links alone."""
    out, blocks, start = [False] * len(tokens), [], 0  # blocks: start, end of those that are links alone, in a row
    for i, t in enumerate([*tokens, None]):
        if t is None or t.words < 0 and t.name in BLOCKS:
            texts = [x for x in tokens[start:i] if x.words > 0]
            if texts and all(x.linked for x in texts):
                blocks.append((start, i))
            if t is None or texts and not all(x.linked for x in texts):
                if len(blocks) >= least:
                    for s, e in blocks:
                        out[s:e] = [x.words > 0 for x in tokens[s:e]]
                blocks = []
            start = i + 1
    return out


def named_place(tokens: list[Token]) -> int:
    """The place that the page's markup names as content: article, main where it holds more beside its articles, or 0."""
    words = [sum(t.words for t in tokens if t.words > 0 and t.place == p) for p in range(3)]
    return 2 if words[2] and words[2] >= words[1] else 1 if words[1] else 0


def scores(tokens: list[Token], weights: RegionWeights) -> list[float]:
    """A score a token. In the element that markup names as content words weigh far more than tags; beside it they score negative."""
    content = named_place(tokens)
    word, tag, other = weights.word, weights.tags, weights.other
    out = []
    for t, of_links, listed in zip(tokens, linked_blocks(tokens), link_lists(tokens)):
        if t.words >= 0:
            value = weights.linked if of_links and not content or listed else word
            out.append(value * t.words if t.place >= content else -word * t.words)
        else:
            out.append(-0.01 * word if content and t.place >= content else tag.get(t.name, other))
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous values with the highest sum; the first of equals, (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, value in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += value
        if total > best:
            best, span = total, (start, i + 1)
    return span


def _widen(tokens: list[Token], run: tuple[int, int]) -> tuple[int, int]:
    """The run's ends moved out to the ends of their blocks."""
    is_block = lambda t: t.words < 0 and t.name in BLOCKS
    start, end = run
    while start > 0 and not is_block(tokens[start - 1]):
        start -= 1
    while end < len(tokens) and not is_block(tokens[end]):
        end += 1
    return start, end


def extract(page: str, weights: RegionWeights) -> str:
    """Blocks of the main content in page order, joined by a line end."""
    tokens = parse(page, weights)
    values = scores(tokens, weights)
    start, end = _widen(tokens, best_run(values))
    blocks, now = [], []
    for t, value in zip(tokens[start:end], values[start:end]):
        if t.words >= 0:
            if value >= 0:
                now.append(t.text)
        elif t.name in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif t.text == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def learn(pages: DataFrame, sample: int = 2_000, most_marks: int = 2_000) -> RegionWeights:
    """Weights from labelled pages, at most ``sample`` of them by a hash of page_id.

    The executors count words, tags and marked words inside and beside the content; what
    reaches the driver is two counts for each name of a fixed list of tags and for the
    ``most_marks`` marks and parts of the most words.
    """
    known = BLOCKS | ASIDE | INLINE | set(CONTENT)

    def make():
        def one(b):
            counts: dict[tuple[str, str], list[int]] = {}
            for page in string_list(b.column("html")):
                marks: list[tuple[str, list[int]]] = []
                tokens = parse(page, None, marks)
                content = named_place(tokens)
                if not content:
                    continue
                for t, of_links in zip(tokens, linked_blocks(tokens)):
                    if t.words >= 0:
                        keys = [("word", ""), *([("linked", "")] if of_links else [])]
                    else:  # a tag with marks tells of these, by the words it holds
                        keys = [("tag", t.text)] if t.text in known and not t.marked else []
                    for key in keys:
                        counts.setdefault(key, [0, 0])[t.place < content] += abs(t.words)
                for mark, words in marks:
                    for key in (("mark", mark), *(("part", p) for p in parts_of(mark))):
                        for place, n in enumerate(words):
                            counts.setdefault(key, [0, 0])[place < content] += n
            columns = [pa.array([k[i] for k in counts], pa.string()) for i in (0, 1)] + [pa.array([v[i] for v in counts.values()], pa.int64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "name", "inside", "beside"])

        return one

    named = pages.where(F.lower("html").rlike("<(article|main)[\\s>]")).select("page_id", "html")
    chosen = named.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)  # ids alone are gathered
    labelled = named.join(F.broadcast(chosen), "page_id")
    found = arrow_map(labelled, ["html"], make, "kind string, name string, inside long, beside long").groupBy("kind", "name").agg(F.sum("inside").alias("inside"), F.sum("beside").alias("beside"))
    marks = found.where("kind in ('mark', 'part')").orderBy((F.col("inside") + F.col("beside")).desc(), "name").limit(most_marks)
    rows = found.where("kind not in ('mark', 'part')").unionByName(marks).collect()
    return weights_from({(r["kind"], r["name"]): (r["inside"], r["beside"]) for r in rows})


def weights_from(counts: dict[tuple[str, str], tuple[int, int]], prior_words: float = 50.0, least: float = -4.0) -> RegionWeights:
    """Log odds of standing inside rather than beside the content: of words (never under a small positive score), of tags (from ``least`` to a small negative one), of marked words, of words in blocks of links (at most a small negative one).

    A mark, or a part of one, is held against its element as far as its words stand beside the content more
    often than others do, ``prior_words`` of the usual mixture taken for granted, and by
    its ``prior_odds``; furniture within the content is no evidence for its marks.
    """
    if not counts:
        return RegionWeights()
    inside, beside = (1 + sum(c[i] for (kind, _), c in counts.items() if kind in ("word", "tag")) for i in (0, 1))
    odds = lambda c: log((c[0] + 0.5) / inside) - log((c[1] + 0.5) / beside)
    words = counts.get(("word", ""), (0, 0))
    usual = [(1 + x) / (2 + sum(words)) for x in words]

    def against(c: tuple[int, int]) -> float:
        return min(0.0, log((c[0] + prior_words * usual[0]) / (c[1] + prior_words * usual[1])) - log(usual[0] / usual[1]))

    return RegionWeights(
        max(0.25, odds(words)),
        RegionWeights.other,
        {name: max(least, min(-0.1, odds(c))) for (kind, name), c in counts.items() if kind == "tag"},
        {name: prior_odds(name) + against(c) for (kind, name), c in counts.items() if kind == "mark"},
        {name: against(c) for (kind, name), c in counts.items() if kind == "part"},
        max(least, min(-0.1, odds(counts[("linked", "")]))) if ("linked", "") in counts else RegionWeights.linked,
    )


def main_text(pages: DataFrame, weights: RegionWeights, keep: list[str] = ["page_id", "url"]) -> DataFrame:
    """``keep`` columns, text and n_chars (code points)."""
    checked_keep(keep, "text", "n_chars")

    def make():
        def one(b):
            texts = [extract(p, weights) for p in string_list(b.column("html"))]
            return pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

        return one

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    return arrow_map(pages, list(dict.fromkeys([*keep, "html"])), make, f"{kept}, text string, n_chars long")
