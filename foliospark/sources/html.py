"""Pages to lines: a page is a list of tokens, tags match by name, and lines are what is left between breaks.

Nothing here keeps a parse state: the reach of every tag is found first, once for the whole page, and then
stretches of tokens are chosen (the text's containers), taken out (what is not text) and split (at breaks, and
tables into cells).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from html.parser import HTMLParser
from itertools import groupby, zip_longest
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROPPED = frozenset(("script", "style", "sup", "nav", "head", "noscript"))
BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote article section header footer br hr center".split())
#: Stands before a line that is bold throughout, where headings are marked so.
HEADING = "# "


class Token(NamedTuple):
    """A tag (``opens`` or not, with attributes) or, without a tag, text; ``end`` is where the matching closing tag is."""

    tag: str
    opens: bool
    text: str
    attrs: dict
    end: int


class _Lexer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, True, "", {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.found.append((tag, False, "", {}))

    def handle_data(self, data):
        self.found.append(("", False, data, {}))


def tokens(page: str) -> list[Token]:
    """A closing tag matches the last open one of its name; what is open inside it ends there too, and what is never closed with the page."""
    lexer = _Lexer()
    lexer.feed(page)
    lexer.close()
    ends, waiting, stack = [len(lexer.found)] * len(lexer.found), {}, []
    for at, (tag, opens, _, _) in enumerate(lexer.found):
        if opens:
            waiting.setdefault(tag, []).append(at)
            stack.append(at)
        elif tag and waiting.get(tag):
            match, inner = waiting[tag][-1], len(lexer.found)
            while inner > match:
                inner = stack.pop()
                ends[inner] = at
                waiting[lexer.found[inner][0]].pop()
    return [Token(*t, end) for t, end in zip(lexer.found, ends, strict=True)]


def _reach(page: list[Token], span: range, test: Callable[[Token], bool]) -> list[range]:
    """The outermost stretches within ``span`` that tokens passing ``test`` open, their own tags included."""
    out, after = [], span.start
    for at in span:
        if at >= after and page[at].opens and test(page[at]):
            end = page[at].end
            after = min(end + (end < len(page) and page[end].tag == page[at].tag), span.stop)
            out.append(range(at, after))
    return out


def _without(spans: list[int], gone: list[range]) -> list[int]:
    lost = {at for r in gone for at in r}
    return [at for at in spans if at not in lost]


def has_class(token: Token, name: str) -> bool:
    return name in token.attrs.get("class", "").split()


def footnote(token: Token) -> bool:
    """Whether a tag is a footnote's mark, or begins its body."""
    href, name, own = (token.attrs.get(k, "") for k in ("href", "name", "id"))
    if token.tag == "a":
        return href.partition("#")[2].startswith(("fn", "_ftn")) or name.startswith(("fn", "_ftn"))
    return token.tag == "div" and own.startswith(("ftn", "fn"))


def _text(part: list[Token]) -> str:
    return " ".join("".join(t.text for t in part).split())


def _bold(part: list[Token]) -> str:
    """The text of a line that is inside bold tags opened on the line."""
    depth, out = 0, []
    for t in part:
        depth += t.opens if t.tag in ("b", "strong") else 0
        depth -= 1 if t.tag in ("b", "strong") and not t.opens and depth else 0
        out += [t] if depth else []
    return _text(out)


#: Tables inside each other that are read down their columns; deeper ones are read as they stand.
DEEPEST = 20


def _flat(page: list[Token], at: list[int], breaks: frozenset, marked: bool) -> list[str]:
    out = []
    for broken, part in groupby((page[x] for x in at), key=lambda t: t.tag in breaks):
        part = [] if broken else [*part]
        if line := _text(part):
            out.append(HEADING + line if marked and _bold(part) == line else line)
    return out


def _table(page: list[Token], at: list[int], breaks: frozenset, marked: bool, depth: int) -> list[str]:
    """Lines of what is inside a table: what stands before its rows, then its cells, column by column."""
    edges = [i for i, x in enumerate(at) if page[x].tag == "tr" and page[x].opens]
    rows = [_lines(page, at[lo:hi], breaks | {"td", "th", "tr"}, marked, depth + 1) for lo, hi in zip([0, *edges], [*edges, len(at)], strict=True)]
    return rows[0] + [cell for column in zip_longest(*rows[1:]) for cell in column if cell is not None]


def _lines(page: list[Token], at: list[int], breaks: frozenset, marked: bool, depth: int = 0) -> list[str]:
    """Lines of the tokens ``at``, one stretch or table after another."""
    out, begin, i = [], 0, 0
    while i < len(at):
        token = page[at[i]]
        if token.tag != "table" or not token.opens or depth >= DEEPEST:
            i += 1
            continue
        after = bisect_left(at, token.end, i + 1)
        out += _flat(page, at[begin:i], breaks, marked) + _table(page, at[i + 1:after], breaks, marked, depth)
        begin = i = after + (after < len(at) and at[after] == token.end)
    return out + _flat(page, at[begin:], breaks, marked)


def html_lines(page: str | None, containers: Callable[[Token], bool] | str = "article", wanted: str | None = None, dropped: Callable[[Token], bool] | frozenset = DROPPED,
               breaks: frozenset = BREAKS, titles: frozenset = frozenset(), marked: bool = False, every: bool = False) -> list[str]:
    """Lines inside the containers (a tag, perhaps of the class ``wanted``, or a test of tokens), the first or ``every`` one.

    Stretches that ``dropped`` (tags, or a test) opens are no text. Lines end at ``breaks``, but a line break
    inside one of ``titles`` is a space. With ``marked``, lines that are bold throughout begin with HEADING.
    """
    all_ = tokens(page or "")
    holds = containers if callable(containers) else lambda t: t.tag == containers and (wanted is None or has_class(t, wanted))
    drops = dropped if callable(dropped) else lambda t: t.tag in dropped
    spans = _reach(all_, range(len(all_)), holds)
    out = []
    for span in spans if every else spans[:1]:
        inside = range(span.start + 1, min(all_[span.start].end, span.stop))
        kept = _without([*inside], _reach(all_, inside, drops))
        for title in _reach(all_, inside, lambda t: t.tag in titles):
            for at in title:
                if all_[at].tag == "br":
                    all_[at] = Token("", False, " ", {}, at)
        out += _lines(all_, kept, breaks, marked)
    return out


def decoded(raw: bytes, other: str | None = None) -> str:
    """UTF-8 or, if there is one, another encoding that the source is in; never loosely."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        if other is None:
            raise
        return raw.decode(other)


#: Of the confession's pages, what is an index, a title or an apparatus, and what ends a line.
MAIN_DROPPED = frozenset(("ol", "ul", "h1", "h2", "sup", "script", "style", "noscript"))
MAIN_BREAKS = frozenset(("p", "div", "li", "center", "blockquote", "br", "h3", "h4", "table", "tr", "td", "th"))


def main_lines(page: str | None, wanted: str = "mainBlock") -> list[str]:
    """Lines of a page whose text is in one container; an h3 is one line."""
    return html_lines(page, "div", wanted, MAIN_DROPPED, MAIN_BREAKS, frozenset(("h3",)))


def report_lines(raw: bytes, marker: str) -> list[str]:
    """Paragraphs of a report after the last line that is ``marker``; bold ones are headings. Footnotes are dropped; the page is UTF-8 or Windows-1252."""
    page = decoded(raw, "cp1252")
    found = html_lines(f"<html>{page}</html>", "html", None, footnote, frozenset(("p", "div", "td")), marked=True)
    at = [i for i, line in enumerate(found) if line.removeprefix(HEADING) == marker]
    return found[at[-1] + 1:] if at else []


def built_lines(page: str | None, title: str, text: str) -> list[str]:
    """Headings (h1 of class ``title``) and paragraphs (div of class ``text``) of pages made by a page builder, in order; footnote marks are dropped."""
    return html_lines(page, lambda t: (t.tag == "h1" and has_class(t, title)) or (t.tag == "div" and has_class(t, text)), None, footnote, frozenset(("p", "div", "h1")), every=True)


def html_extract(pages: DataFrame, container: str = "article", wanted: str | None = None) -> DataFrame:
    """page_id, text: the container's lines; no built-in function parses HTML, so this is an Arrow map."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["\n".join(html_lines(h, container, wanted)) for h in b.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string")
