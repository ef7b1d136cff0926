"""Main text of web pages by line-block distribution.

Markup is stripped so that every block of a page becomes a line; blocks of menus, headers,
footers, sidebars, notices, adverts, forms and comments are none. A line weighs what it has
of text outside links. Two or more lines in a row that are mostly links are a menu and weigh
nothing, nor do lines of rights reserved outside articles. If the page marks articles, or else its main part, lines
outside weigh nothing and those inside four times as much; an article with less than a third of the
text of the largest is a teaser and counts as outside. Weights are summed over a sliding window of
lines: text starts where the sum surges and ends where it dives to 0, and what lies between
and weighs something is kept. A page whose windows all stay below a surge has its own, lower surge
point: half of its greatest sum.

Null, empty and text-free pages give an empty text. Broken markup is read as far as it
goes, in time that grows with the page's length: unclosed elements end with their parent,
an element of raw text that is never closed loses its tag only (a script or style the
rest of the page), a cut-off tag at the end is dropped. Repeated rows and null ids each
give a row; very long pages are read whole; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: Attributes up to the tag's end; quotes count after = only, as in browsers.
_QUOTED = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^"'])|\Z))*+>""")
_UNQUOTED = re.compile(r"[^<>]*+>?")
#: Their content is text, not markup.
_RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
#: Elements that count only if they are closed, as they'd take the rest of the page with them.
_CLOSED = frozenset("svg math template noscript select object canvas video audio".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("head title nav footer aside form button dialog menu".split()) | _CLOSED
_OPEN_ENDED = frozenset("p li dd dt td th tr option".split())
_CONTAINERS = frozenset("div section aside nav ul ol dl dir menu table header footer form details dialog fieldset figure".split())
_HINT = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|"
    r"sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|comment(?:s|ers?|list|form|box|area|section|thread)?|disqus|repl(?:y|ies)|responses?|respond|discussion|"
    r"related|recommend\w*|share|sharing|social|footer|masthead|topbar|widget|skip|login|signup|search"
)
#: Words that say of a hint only where or what kind of element it is.
_LAYOUT = re.compile(
    r"site|page|global|main|primary|secondary|top|bottom|left|right|sticky|fixed|js|box|wrapper|wrap|container|holder|inner|outer|bar|block|"
    r"section|area|panel|pane|region|slot|unit|list|items?|links?|buttons?|btns?|icons?|form|posts?|articles?|stories|entry|blog|reader|user|law|info|"
    r"thread|to|content|\d+(?:x\d+)?"
)
#: Words are parted by - and _, and before a capital within one.
_JOINT = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")
#: A line that says whose the rights are.
_RIGHTS = re.compile(r"(?:copyright\s*)?(?:©|\(c\))\s*\S.{0,100}|copyright\s+\d{4}\b.{0,100}|.{0,60}\ball rights reserved\.?", re.IGNORECASE)
#: How much more a line weighs that the page marks as its text.
MARKED = 4

_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu".split())
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)


@lru_cache(maxsize=100_000)
def _hinted(name: str) -> bool:
    """Whether a class name or id as a whole says boilerplate: words of hints, and of layout beside them."""
    words = [w.lower() for w in _JOINT.split(name) if w]
    hints = [bool(_HINT.fullmatch(w)) for w in words]
    return any(hints) and all(h or _LAYOUT.fullmatch(w) for h, w in zip(hints, words, strict=True))


def _boilerplate(name: str, attrs: str, within: bool) -> bool:
    if name in _SKIPPED or (name == "header" and not within):
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)  # noqa: PLW2901
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and _NO_DISPLAY.search(value)):
            return True
        if key == "role" and not _ROLES.isdisjoint(value.lower().split()):
            return True
        if (key == "class" or (key == "id" and name in _CONTAINERS)) and any(map(_hinted, value.split())):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of every piece of markup; comments and raw elements have no name.

    Every search that can fail for want of an end does so once a page, so that time is linear.
    """
    low = page.lower()
    last: dict[str, int] = {}
    quotes, at = True, 0

    def closed(name: str, after: int) -> bool:
        if name not in last:
            last[name] = low.rfind(f"</{name}")
        return last[name] >= after

    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif m := _NAME.match(page, at + 1):
            name, rest = m[1].lower(), None
            if quotes:
                rest = _QUOTED.match(page, m.end())
                quotes = rest is not None
            rest = rest or _UNQUOTED.match(page, m.end())
            end, attrs = rest.end(), rest[0].removesuffix(">")
            closes = page[at + 1] == "/"
            if name in _RAW and not closes and not attrs.endswith("/"):
                stop = low.find(f"</{name}", end) if closed(name, end) else -1
                if stop >= 0 or name in ("script", "style"):
                    end = len(page) if stop < 0 else (page.find(">", stop) + 1 or len(page))
                yield at, end, "", False, ""
            elif name in _CLOSED and not closes and not closed(name, end):
                yield at, end, "", False, ""
            else:
                yield at, end, name, closes, attrs
        elif page.startswith(("<!", "<?", "</"), at):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            yield at, end, "", False, ""
        elif at + 1 == len(page):
            end = at + 1
            yield at, end, "", False, ""
        else:
            end = at + 1  # a plain less-than sign
        at = end


class _Open:
    """The open elements, with what holds inside the innermost and how many there are of a name."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, str]] = []  # name, skipped, the innermost of article and main
        self.count: dict[str, int] = {}

    def state(self) -> tuple[bool, str]:
        return self.stack[-1][1:] if self.stack else (False, "")

    def push(self, name: str, skipped: bool, within: str) -> None:
        self.stack.append((name, skipped, within))
        self.count[name] = self.count.get(name, 0) + 1

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.count[name] -= 1
        return name

    def close(self, name: str) -> None:
        if self.count.get(name):
            while self.pop() != name:
                pass


def page_lines(page: str) -> list[tuple[str, int, str]]:
    """(text, characters in links, the article or main that it's in, with its number) of every block with text in page order, but boilerplate."""
    lines: list[tuple[str, int, str]] = []
    parts: list[str] = []
    open_ = _Open()
    linked, marks = 0, 0

    def flush() -> None:
        nonlocal linked
        if line := " ".join("".join(parts).split()):
            lines.append((line, linked, open_.state()[1]))
        parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not open_.state()[0]:
            parts.append(decoded := html.unescape(piece) if "&" in piece else piece)
            if open_.count.get("a"):
                linked += len(decoded.strip())

    at = 0
    for start, end, name, closes, attrs in tags(page):
        text(page[at:start])
        at = end
        if not name:
            continue
        if name in _BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if name in _VOID:
            continue
        if closes:
            open_.close(name)
            continue
        if attrs.endswith("/"):
            continue
        if name in ("article", "main"):  # an element left open before it doesn't hold it
            while open_.stack and open_.stack[-1][1] and open_.stack[-1][0] not in ("aside", "footer", "form", "article"):
                open_.pop()
        if name in _OPEN_ENDED and open_.stack and open_.stack[-1][0] == name:
            open_.pop()
        skipped, within = open_.state()
        skipped = skipped or _boilerplate(name, attrs, bool(within))
        if name in ("article", "main") and not skipped and not within.startswith("article"):
            marks += 1
            within = f"{name} {marks}"
        open_.push(name, skipped, within)
    text(page[at:])
    flush()
    return lines


def marked(lines: list[tuple[str, int, str]]) -> set[str]:
    """The articles of the page that are no teasers, else its main parts; none if it marks neither."""
    size: dict[str, int] = {}
    for text, linked, within in lines:
        size[within] = size.get(within, 0) + max(1, len(text) - linked)
    found = {m: n for m, n in size.items() if m.startswith("article")} or {m: n for m, n in size.items() if m}
    return {m for m, n in found.items() if 3 * n >= max(found.values())}


def weigh(lines: list[tuple[str, int, str]]) -> list[int]:
    """The weight of each line: its text outside links, more where the page marks its text, nothing in menus and where others are marked."""
    best = marked(lines)
    links = [2 * linked > len(text) for text, linked, _ in lines]
    out = []
    for i, (text, linked, within) in enumerate(lines):
        menu = links[i] and (not best or any(links[max(0, i - 1) : i] + links[i + 1 : i + 2]))
        if menu or best and within not in best or not within.startswith("article") and len(text) <= 160 and _RIGHTS.fullmatch(text):
            out.append(0)
        else:
            out.append(max(1, len(text) - linked) * (MARKED if best else 1))
    return out


def keep_lines(weight: list[int], window: int, surge: int) -> list[bool]:
    """Whether each line lies between a surge point and the next dive point and weighs something.

    A line's sum is that of the window that begins with it. Text begins at a line with a
    weight whose sum reaches the surge and ends before the first line whose sum is 0.
    """
    total = [0]
    for n in weight:
        total.append(total[-1] + n)
    sums = [total[min(i + window, len(weight))] - total[i] for i in range(len(weight))]
    least = min(surge, max(1, max(sums, default=0) // 2))
    kept, within = [], False
    for n, ahead in zip(weight, sums, strict=True):
        within = ahead > 0 and (within or (n > 0 and ahead >= least))
        kept.append(within and n > 0)
    return kept


def main_text(page: str | None, window: int = 3, surge: int = 60) -> str:
    """The text between surge and dive points, blocks joined by one line feed."""
    if not page:
        return ""
    lines = page_lines(page)
    kept = keep_lines(weigh(lines), window, surge)
    return "\n".join(text for (text, _, _), k in zip(lines, kept, strict=True) if k)


def extract_text(pages: DataFrame, window: int = 3, surge: int = 60) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), window, surge) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
