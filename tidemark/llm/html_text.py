"""Main text of web pages by the distribution of line blocks.

A page is stripped of its markup into lines, one for each block of text; what is
never article text (menus, page headers and footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) is stripped with it and leaves
empty lines. Over the lines slides a window of ``WINDOW`` of them. Where the
sum of text lengths rises above ``SURGE`` text sets in, and it holds from the
point where the sum left zero (so that short first lines stay) to the point
where it dives to zero again. All lines between are kept whole, however short.

Link text does not count as length outside ``article`` and ``main`` elements,
so that lists of links never surge. Where a page has such an element its lines
alone are candidates. If no window surges (short pages), the candidates inside
such an element are kept, else the one stretch with the highest sum.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.frames import quoted

WINDOW = 3
SURGE = 80

# Element names by their part on a page.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl
dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre
search section summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = frozenset("""article aside body div dl fieldset footer form header main nav ol section table
tbody tr ul""".split())
VOID = frozenset("""area base br col embed hr img input link meta param source track wbr""".split())
RAW = frozenset("""iframe noembed noframes noscript script style template textarea title xmp""".split())
CHROME = frozenset("""aside footer form header menu nav search dialog""".split())
UNREAD = frozenset("""audio button canvas datalist head map math object select svg video""".split())
SELF_CLOSING = frozenset("""dd dt li option td th tr""".split())
HEADINGS = frozenset("""h1 h2 h3 h4 h5 h6""".split())
SCOPES = frozenset("""article main""".split())
# Words at the start or end of a class, id or role that mark such parts.
MARKS = frozenset("""ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs
consent cookie cookies copyright disclaimer footer gdpr header login masthead menu menubar modal nav navbar
navigation newsletter notice notification pager pagination popup promo promoted promotion recommended
related search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser teasers
toolbar topbar widget widgets""".split())
DISCUSSION = frozenset("""comment comments commentlist discussion disqus replies reply respond responses""".split())
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside",
         "search": "search", "form": "form", "dialog": "dialog", "alert": "notice", "main": "main",
         "article": "article"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)",
    re.S)
NAMED = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _mark(attributes: str) -> str | None:
    """What a class, id or role makes of an element: ``comments``, ``chrome`` or
    an element's name; None where they say nothing."""
    found = None
    for name, *values in NAMED.findall(attributes):
        value = html.unescape("".join(values))
        if name.lower() == "role":
            role = ROLES.get(value.strip().lower())
            found = role if role in SCOPES else "chrome" if role else found
            continue
        for label in value.split():
            words = [w.lower() for w in WORDS.findall(label)]
            if not words or words[0] in ("has", "no", "with", "without", "is", "js"):
                continue
            if words[0] in DISCUSSION or words[-1] in DISCUSSION:
                return "comments"
            if words[-1] == "header":
                found = found or "header"
            elif words[0] in MARKS or words[-1] in MARKS:
                found = "chrome"
    return found


class Lines:
    """The lines of one page: texts with the lengths that the windows sum."""

    def __init__(self):
        self.texts: list[str] = []
        self.lengths: list[int] = []
        self.scoped: list[bool] = []
        self._parts: list[str] = []
        self._plain = 0
        self._home = None

    def text(self, raw: str, counts: bool) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        self._parts.append(raw)
        if counts:
            self._plain += len(raw) - raw.count(" ")

    def space(self) -> None:
        if self._parts:
            self._parts.append(" ")

    def end(self, scoped: bool, home: int) -> None:
        """A line ends with its block. Two lines of the same container (``home``)
        are one empty line apart at most, whatever was stripped between them."""
        if self._parts:
            line = " ".join("".join(self._parts).split())
            if line:
                while home == self._home and len(self.texts) > 1 and not (self.texts[-1] or self.texts[-2]):
                    for column in (self.texts, self.lengths, self.scoped):
                        column.pop()
                self._home = home
                self.texts.append(line)
                self.lengths.append(max(1, min(self._plain, len(line))) if self._plain or scoped else 0)
                self.scoped.append(scoped)
            self._parts.clear()
            self._plain = 0

    def gap(self, n: int) -> None:
        """At least ``n`` empty lines end the list."""
        have = 0
        while have < n and have < len(self.texts) and not self.texts[-1 - have]:
            have += 1
        for _ in range(n - have if self.texts else 0):
            self.texts.append("")
            self.lengths.append(0)
            self.scoped.append(False)


def lines_of(page: str, window: int = WINDOW) -> Lines:
    """A page without markup and without the parts that are never its article."""
    out = Lines()
    stack: list[str] = []       # open block elements, and the stripped one
    scopes: list[int] = []      # stack heights of open article and main elements
    homes: list[tuple[int, int]] = []   # stack heights and numbers of open containers
    dropped, why = 0, ""        # stack height of the stripped element (0: none), and its kind
    in_link = False
    at, size, made = 0, len(page), 0

    def end_line() -> None:
        out.end(bool(scopes), homes[-1][1] if homes else 0)

    def close(height: int) -> None:
        nonlocal dropped, why
        del stack[height:]
        while scopes and scopes[-1] > height:
            scopes.pop()
        while homes and homes[-1][0] > height:
            homes.pop()
        if height < dropped:
            dropped, why = 0, ""

    def push(name: str) -> None:
        nonlocal made
        stack.append(name)
        if name in CONTAINERS:
            made += 1
            homes.append((len(stack), made))

    while at < size:
        token = TOKEN.search(page, at)
        start = token.start() if token else size
        if start > at and (not dropped or (why == "header" and scopes and stack[-1] in HEADINGS)):
            out.text(page[at:start], bool(scopes) or not in_link)
        if not token:
            break
        at = token.end()
        name = token[2]
        if name is None:
            continue
        name = name.lower()
        if token[1]:                                    # an end tag
            if name == "a":
                in_link = False
            if name in BLOCKS:
                end_line()
                if name in CONTAINERS and not dropped:
                    out.gap(1 if scopes else 2)
            for height in range(len(stack) - 1, -1, -1):
                if stack[height] == name:
                    if not (dropped and height + 1 < dropped and name not in CONTAINERS):
                        close(height)
                    break
            continue
        if name in RAW:
            end = ENDS[name].search(page, at)
            at = end.start() if end else size
            continue
        if name in VOID:
            if name == "hr":
                end_line()
            elif name == "br":
                out.space()
            continue
        if name == "a":
            in_link = True
        if name in BLOCKS:
            end_line()
            if stack and stack[-1] == "p":
                close(len(stack) - 1)                   # a block ends an open paragraph
            if stack and stack[-1] == name and name in SELF_CLOSING:
                close(len(stack) - 1)
        attributes = token[3]
        mark = None if name in ("html", "body") or name in HEADINGS or not attributes \
            else _mark(attributes)
        if (name in SCOPES or mark in SCOPES) and mark != "comments" and why != "comments":
            dropped, why = 0, ""                        # an article is never inside a menu
            push(name)
            scopes.append(len(stack))
            continue
        if not dropped:
            kind = ("comments" if mark == "comments" else "unread" if name in UNREAD
                    else "header" if name == "header" or mark == "header" and name in BLOCKS
                    else "chrome" if name in CHROME or mark == "chrome" else None)
            if kind and not attributes.rstrip().endswith("/"):
                if name in BLOCKS:
                    end_line()
                    if kind != "unread":
                        out.gap(1 if scopes else window)
                push(name)
                dropped, why = len(stack), kind
                continue
        if name in BLOCKS or dropped and name == stack[dropped - 1]:
            push(name)
            if name in CONTAINERS and not dropped:
                out.gap(1 if scopes else 2)
    end_line()
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The kept lines of a page, joined by an empty line; empty if there are none."""
    found = lines_of(page or "", window)
    inside = any(found.scoped)
    lengths = [n if s or not inside else 0 for n, s in zip(found.lengths, found.scoped)]
    n = len(lengths)
    sums, total = [], 0
    for i in range(n + window - 1):                     # the window that ends at line i
        total += (lengths[i] if i < n else 0) - (lengths[i - window] if i >= window else 0)
        sums.append(total)
    # Stretches from where the sum leaves zero to where it dives to zero again.
    stretches, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        dive = next((j for j in range(i, len(sums)) if not sums[j]), len(sums))
        stretches.append((max(sums[i:dive]), i, min(n, dive)))
        i = dive
    kept = [s for s in stretches if s[0] > surge]
    if not kept:
        kept = stretches if inside else sorted(stretches, key=lambda s: (-s[0], s[1]))[:1]
    return "\n\n".join(found.texts[j] for _, start, end in kept for j in range(start, end)
                       if found.texts[j] and (found.scoped[j] or not inside))


def extract_main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url",
                      page: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every page, in one narrow pass.

    A null or empty page, and one of markup alone, gives an empty text. Repeated
    rows keep their own row; whole pages are read, however long. Empty input
    gives no rows; other columns are ignored.
    """
    key, link, body = quoted(pages, page_id, url, page)
    plain = pages.select(key.alias("page_id"), link.alias("url"), body.alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("html")
            texts = [main_text(column[i].as_py(), window, surge) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    types = [plain.schema[n].dataType.simpleString() for n in ("page_id", "url")]
    return plain.mapInArrow(extract, f"page_id {types[0]}, url {types[1]}, text string, n_chars long")
