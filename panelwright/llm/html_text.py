"""Main text of raw web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML ------------------------------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no page text.
SILENT = frozenset("head script style noscript template title textarea iframe object svg math canvas select datalist audio video".split())
#: Silent elements whose content is plain characters up to their own end tag: no tags, no comments.
RAW = frozenset("script style noscript title textarea iframe".split())
#: What may stand in a head; any other tag ends one that is not closed.
HEAD = frozenset("base link meta title style script noscript template head".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr br""".split())
#: A start tag of the key closes an open element of the values, up to the nearest element of ``SCOPE``.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl article section div main body html td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Pieces of running text, which in an article only the name of an advert or of readers' comments makes something else.
RUNNING = HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption".split())
#: Elements that give text a form inside a container and are no containers themselves.
FORMS_OF_TEXT = RUNNING | frozenset("ul ol dl table thead tbody tfoot tr caption figure hr".split())
#: Blocks that are text of their own also when all of it is a link.
STANDING = HEADINGS | frozenset("p dt dd blockquote pre figcaption caption".split())
# Parts of a page that are not its article -----------------------------------------------------------------------------
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Aside tags that some pages wrap around all they have.
WRAPPERS = frozenset("form fieldset dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
ASIDE_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie
cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu
breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar related recommended recommendations widget widgets share sharing social
comment comments commentlist disqus reply replies respond pagination pager skip""".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored".split())
#: Names that make an inline element something else than text.
INLINE_NAMES = ADVERTS | {"skip", "share", "sharing"}
#: Words that say where or what shape a named element is; a compound counts only if all its words are these or names above.
SHAPES = frozenset("""site page main left right top bottom box container wrapper wrap list block section area bar item items inner outer primary
secondary global slot unit zone links link buttons button icons posts form thread user mobile desktop text message bottom header""".split())
KEPT_FRAMES = frozenset("html body main article".split())
# ----------------------------------------------------------------------------------------------------------------------

#: A path is content if its fused ratio reaches this share of the page's mean, weighted by text length.
MIN_SHARE = 0.05
#: An <article> or <main> frames the page's text unless the text outside it, weighted by its ratios, is so many times as much.
OUTWEIGHS = 3.0

_NAME_OF_TAG = re.compile(r"[^\s/>]*")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_TOLD = frozenset("class id role hidden aria-hidden style".split())
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


@dataclass(eq=False)
class _Mark:
    """An element whose tag, role, class or id names something other than the article; ``outer`` is the mark around it."""

    outer: _Mark | None
    readers: bool
    firm: bool
    among_readers: bool = False

    def __post_init__(self):
        self.among_readers = self.readers or self.outer is not None and self.outer.among_readers


@dataclass(eq=False)
class _Node:
    """An open element. ``path`` and ``container`` number tag paths, ``scope`` counts the open tags down to the next scope."""

    tag: str
    path: int
    container: int
    mark: _Mark | None
    article: int | None
    main: int | None
    scope: Counter


@dataclass(eq=False)
class Block:
    """Text between two block boundaries; ``article`` and ``main`` number the elements it lies in, ``linked`` says that all
    of it is link text."""

    path: int
    container: int
    mark: _Mark | None
    article: int | None
    main: int | None
    standing: bool
    linked: bool = True
    pieces: list[str] = field(default_factory=list)
    text: str = ""
    aside: bool = False

    @property
    def framed(self) -> bool:
        return self.article is not None or self.main is not None

    @property
    def key(self) -> tuple[int, bool]:
        """The tag path; that of text that is nothing but links goes on to the link."""
        return self.path, self.linked and not self.standing


class _Scanner:
    """Finds tags from left to right. Each character is looked for once however often it is asked for, so no page takes
    more than time in proportion to its length."""

    def __init__(self, html: str):
        self.html, self._at = html, {}

    def next(self, what: str, begin: int) -> int:
        """Where ``what`` comes next; the length of the page if it does not."""
        at = self._at.get(what, -1)
        if at < begin:
            at = self.html.find(what, begin)
            at = self._at[what] = len(self.html) if at < 0 else at
        return at

    def end_of_tag(self, begin: int) -> int:
        """The > that ends a tag. A quote after = protects a value, unless it is never closed: then the tag ends at the next >."""
        html, i = self.html, begin
        while True:
            end = self.next(">", i)
            quote = min(self.next('"', i), self.next("'", i))
            if end <= quote:
                return end
            i = quote + 1
            before = quote - 1
            while before > begin and html[before].isspace():
                before -= 1
            if html[before] == "=":
                close = self.next(html[quote], i)
                plain = close < min(end, self.next("<", i))
                if close == len(html) or not plain and html[close + 1:close + 2] not in ("", " ", "\n", "\t", "\r", "\f", "/", ">"):
                    return end
                i = close + 1

    def tokens(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text, tag, is an end tag, attributes) in order; comments and declarations give an empty tag."""
        html, done, look = self.html, 0, 0
        while (at := html.find("<", look)) >= 0:
            head = html[at + 1:at + 3]
            if html.startswith("<!--", at):
                end = self.next("-->", at + 4)
                yield html[done:at], "", False, ""
                done = look = min(end + 3, len(html))
            elif head[:1] in ("!", "?"):
                yield html[done:at], "", False, ""
                done = look = min(self.next(">", at) + 1, len(html))
            elif (name := head[1:] if head[:1] == "/" else head[:1]).isascii() and name.isalpha():
                closing = head[0] == "/"
                m = _NAME_OF_TAG.match(html, at + 1 + closing)
                end = self.end_of_tag(m.end())
                tag, attributes = m[0].lower(), html[m.end():end]
                text, done = html[done:at], min(end + 1, len(html))
                if tag in RAW and not closing and not attributes.endswith("/"):
                    stop = _RAW_END[tag].search(html, done)
                    done = stop.end() if stop else len(html)
                yield text, tag, closing, attributes
                look = done
            else:
                look = at + 1
        yield html[done:], "", False, ""


def _told(attributes: str) -> dict[str, str]:
    if not attributes or attributes.isspace():
        return {}
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in _TOLD:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    return found


def _names(value: str) -> set[str]:
    """Words of those names of a class or id that say what an element is."""
    found: set[str] = set()
    for token in value.split():
        words = {x.lower() for x in _WORD.findall(token)}
        if words <= ASIDE_NAMES | SHAPES:
            found |= words & ASIDE_NAMES
    return found


def _hidden(told: dict[str, str]) -> bool:
    return "hidden" in told or told.get("aria-hidden") == "true" or bool(_HIDDEN.search(told.get("style", "")))


def _mark(tag: str, attributes: str, framed: bool, outer: _Mark | None) -> _Mark | None:
    """The mark of an element, or the one around it. Marks of hidden elements, menus and footers are firm: only an article in
    them makes them void."""
    told = _told(attributes)
    names = _names(told.get("class", ""))
    if tag not in HEADINGS:
        names |= _names(told.get("id", ""))
    names &= READERS if tag in KEPT_FRAMES else ADVERTS | READERS if framed and tag in RUNNING else ASIDE_NAMES
    by_tag = tag in ASIDE_TAGS or tag == "header" and not framed
    if tag in KEPT_FRAMES:
        if not names:
            return outer
        return _Mark(outer, True, False)
    firm = by_tag and tag not in WRAPPERS or _hidden(told)
    if firm or by_tag or names or told.get("role", "").strip().lower() in ASIDE_ROLES:
        return _Mark(outer, bool(names & READERS), firm)
    return outer


def _outside(found: list[Block], opened: dict[int, _Mark | None], marks: list[_Mark]) -> None:
    """Puts blocks under a mark outside the article, unless what the mark names holds the page's article or most of its text.

    The page's article is the longest <article> outside all marks, else the longest under a mark that is not readers', else
    the longest of all; without any, the longest <main> in the same order. Marks around it, and those in it that hold all of it,
    are void. On a page without either, a mark that holds more than half of the text is void if it is neither firm nor readers',
    and the largest is void where nothing is left outside. A page's form is an example of the first and of the second.
    """
    def held(blocks: list[Block]) -> Counter:
        """Text under each mark; inner marks come after outer ones in ``marks``."""
        sizes = Counter()
        for b in blocks:
            if b.mark is not None:
                sizes[b.mark] += len(b.text)
        for m in reversed(marks):
            if m.outer is not None:
                sizes[m.outer] += sizes[m]
        return sizes

    within: dict[int, list[Block]] = defaultdict(list)
    for b in found:
        frame = b.article if b.article is not None else None
        if frame is not None:
            within[frame].append(b)
    if not within:
        for b in found:
            if b.main is not None:
                within[b.main].append(b)
    void: set[_Mark] = set()
    whole = sum(len(b.text) for b in found)
    if within:
        size = {f: sum(len(b.text) for b in bs) for f, bs in within.items()}

        def rank(f: int) -> tuple[int, int]:
            around = opened[f]
            return (2 if around is None else 0 if around.among_readers else 1 if 2 * size[f] <= whole else 2), size[f]

        ours = max(within, key=rank)
        around = opened[ours]
        while around is not None:
            void.add(around)
            around = around.outer
        void |= {m for m, n in held(within[ours]).items() if n == size[ours] and not m.firm}
    else:
        sizes = held(found)
        firm_or_readers: set[_Mark] = set()
        for m in marks:
            if m.firm or m.readers or m.outer in firm_or_readers:
                firm_or_readers.add(m)
        free = sum(len(b.text) for b in found if b.mark not in firm_or_readers)
        loose = {m: n for m, n in sizes.items() if m not in firm_or_readers and n}
        void = {m for m, n in held([b for b in found if b.mark not in firm_or_readers]).items() if 2 * n > free and m in loose}
        dropped = _dropped(marks, void)
        if loose and all(b.mark in dropped for b in found):
            largest = max(loose.values())
            void |= {m for m, n in loose.items() if n == largest}
    dropped = _dropped(marks, void)
    for b in found:
        b.aside = b.mark in dropped


def _dropped(marks: list[_Mark], void: set[_Mark]) -> set[_Mark]:
    """Marks that stand, and marks within them."""
    out: set[_Mark] = set()
    for m in marks:
        if m not in void or m.outer in out:
            out.add(m)
    return out


def blocks(html: str) -> list[Block]:
    """Text blocks of a page in order. Tags that are never closed, or closed out of order, are tolerated, and a page of any
    shape takes time and memory in proportion to its length."""
    numbers: dict[tuple[int, str], int] = {}

    def number(above: int, tag: str) -> int:
        return numbers.setdefault((above, tag), len(numbers) + 1)

    stack = [_Node("", 0, 0, None, None, None, Counter())]
    is_open, frames, marks = Counter(), {}, []
    out: list[Block] = []
    current: Block | None = None
    silent, depth = None, 0
    link = 0                                    # depth of the stack where a link was opened, 0 outside links

    def pop_from(i: int) -> None:
        nonlocal link
        for node in stack[i:]:
            node.scope[node.tag] -= 1
            is_open[node.tag] -= 1
        del stack[i:]
        if len(stack) < link:
            link = 0

    def close_for(tag: str) -> None:
        """Closes the elements that a start tag ends, up to the nearest scope that has none of them."""
        doomed = CLOSES.get(tag, set()) | {"p"}
        i, at = len(stack) - 1, len(stack)
        while i > 0:
            scope = stack[i].scope
            left = sum(scope[x] for x in doomed)
            if not left:
                break
            while left:
                if stack[i].tag in doomed:
                    at, left = i, left - 1
                i -= 1
            root = stack[at]
            if not (root.tag in SCOPE and i >= 0 and stack[i].scope is not scope):
                break
        pop_from(at)

    for text, tag, closing, attributes in _Scanner(html).tokens():
        if text and silent is None:
            if current is None and not text.isspace():
                top = stack[-1]
                current = Block(top.path, top.container, top.mark, top.article, top.main, top.tag in STANDING)
                out.append(current)
            if current is not None:
                current.pieces.append(text)
                current.linked &= bool(link) or text.isspace()
        if silent == "head" and tag and not closing and tag not in HEAD or silent in INLINE and tag and tag not in INLINE:
            silent = None
        if not tag:
            continue
        if tag in RAW and not closing:
            if silent is None and not attributes.endswith("/"):
                current = None
            continue
        if silent is not None:
            if tag == silent and not attributes.endswith("/"):
                depth += -1 if closing else 1
                if depth == 0:
                    silent = None
            continue
        if tag == "br":
            if current is not None:
                current.pieces.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else len(stack)
            if not closing and tag not in VOID and attributes:
                told = _told(attributes)
                if _hidden(told) or told.get("role", "").lower() in ASIDE_ROLES or _names(told.get("class", "")) & INLINE_NAMES:
                    silent, depth = tag, 1
            continue
        current = None
        if closing:
            if is_open[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                pop_from(i)
        elif tag in SILENT:
            if not attributes.endswith("/"):
                silent, depth = tag, 1
        elif tag not in VOID:
            close_for(tag)
            top = stack[-1]
            mark = _mark(tag, attributes, top.article is not None or top.main is not None, top.mark)
            if mark is not top.mark:
                marks.append(mark)
            place = len(frames)
            if tag in ("article", "main"):
                frames[place] = mark
            scope = Counter() if tag in SCOPE else top.scope
            scope[tag] += 1
            is_open[tag] += 1
            stack.append(_Node(tag, number(top.path, tag), top.container if tag in FORMS_OF_TEXT else number(top.container, tag), mark,
                               place if tag == "article" else top.article, place if tag == "main" else top.main, scope))
    for b in out:
        b.text = " ".join(unescape("".join(b.pieces)).split())
    out = [b for b in out if b.text]
    _outside(out, frames, marks)
    return out


def path_ratios(found: list[Block]) -> tuple[dict[tuple[int, bool], float], float]:
    """Fused ratio of every tag path of blocks that are not aside, and the ratio that content needs.

    Text length and punctuation are added up by path and divided by the path's blocks. Along the page each of the two is
    smoothed with those of the neighbours (one part, two, one part; aside blocks count 0, the ends repeat), and fused to
    length * (1 + punctuation). A path's ratio is the mean over its blocks; the threshold is ``MIN_SHARE`` of the page's mean,
    weighted by text length.
    """
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        if not b.aside:
            length[b.key] += len(b.text)
            marks[b.key] += len(_PUNCTUATION.findall(b.text))
            count[b.key] += 1
    ratio = [(0.0, 0.0) if b.aside else (length[b.key] / count[b.key], marks[b.key] / count[b.key]) for b in found]
    padded = [ratio[0], *ratio, ratio[-1]] if ratio else []
    fused, total, weight = defaultdict(float), 0.0, 0
    for i, b in enumerate(found):
        if not b.aside:
            text, punctuation = ((padded[i][j] + 2 * padded[i + 1][j] + padded[i + 2][j]) / 4 for j in (0, 1))
            value = text * (1 + punctuation)
            fused[b.key] += value / count[b.key]
            total += value * len(b.text)
            weight += len(b.text)
    return fused, MIN_SHARE * total / weight if weight else 0.0


def content(found: list[Block]) -> list[Block]:
    """The blocks of content paths.

    A path is content if its ratio (``path_ratios``) reaches the threshold. Lists, tables and headings, whose texts are short,
    go with their container: a path that is not all links is content too if another path of the same container is. An <article>,
    else a <main>, frames the text: blocks outside it are left out, and what is not all links inside it is content; but a frame is
    void if the text outside, weighted by ratio, is ``OUTWEIGHS`` times that inside. Links alone, as in lists of
    pages to share or to go on to, are content only by the ratio of their own path.
    """
    fused, limit = path_ratios(found)
    ours = [b for b in found if not b.aside]
    article = any(b.article is not None for b in ours)
    inside = [b for b in ours if (b.article if article else b.main) is not None]
    if inside:
        worth = sum(fused[b.key] * len(b.text) for b in inside)
        if sum(fused[b.key] * len(b.text) for b in ours) - worth > OUTWEIGHS * worth:
            inside = []
    chosen = inside or ours
    good = {key for key in {b.key for b in chosen} if fused[key] >= limit}
    containers = {b.container for b in chosen if b.key in good and not b.key[1]}
    return [b for b in chosen if b.key in good or not b.key[1] and (bool(inside) or b.container in containers)]


def main_text(html: str | None) -> str:
    return "\n".join(b.text for b in content(blocks(html or "")))


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(``keep``, text, n_chars) of every row, repeated rows included.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one line break.
    A NULL or empty page, or one of menus and the like alone, gives empty text. The whole page is read, whatever its length.
    """
    kept = pages.select(*keep, F.col(html_col).alias("_html"))
    fields = [f for f in kept.schema.fields if f.name != "_html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("_html").to_pylist()]
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [*(f.name for f in fields), "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return kept.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
