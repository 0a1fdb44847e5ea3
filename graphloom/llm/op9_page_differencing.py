"""HTML extraction by differencing pages with their nearest URLs.

Each page is cut into text blocks. Pages are sorted by host and URL path, and each is
aligned with the nearest different pages on either side, within the host, by the longest
common subsequence of its lines; shared lines are the site's template and are deleted.
Copies of a page prove nothing and are passed over, however many there are. Whether a page
is a copy is judged by the lines that are left after those common to the host are taken
out: lines on at least COMMON different pages and on half of them. Pages count as
different if neither host and path nor the lines are equal.
Markup decides only what it states: scripts, styles, forms, navigation, headers, footers,
asides and boxes with a whole name of adverts, notices or comments are never text, and
what lies inside article or main is protected, since copies of one article under two
URLs share all of it; inside, only boxes of adverts and comments, and those with a COMPOUND name, go. A first
heading in a header is text where the page has no landmark and no page near it shares it.

The sort is a range exchange of line hashes, once in each direction, so that a page meets
only pages before it and a task holds a few different pages at a time. The pages at the
beginning of a partition that find too few go on with the last different pages of the
partitions before, in a second pass over these pages only. No host is gathered in one task.

Results for edge cases: a null or empty html, or one without text, has an empty text and
0 characters; pages of equal host and path are ordered by url, page_id and lines, so that the
input's order does not matter; a null url belongs to the host and path that are empty; a page that is
alone in its host keeps its lines; a tag without an end is text, and a very long or broken
page is read whole, in time that grows with its length; a page without landmarks that shares half
of the lines and four fifths of the characters left of it with another is a copy (of the
whole, where less than a fiftieth of the characters is left); repeated rows are each
returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.staging import partitions, prepare, scratch, stage

NEAR = 2  # different pages on each side
COPY = 0.8  # share of the characters left of a page that marks a copy, with half of the lines
COMMON = 3  # different pages of a host, at least, that have a common line
LITTLE = 0.02  # of a page's characters: too little left to judge by
# Possessive, so that a tag without an end is read once and not once for each place where it might be cut.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|</?[a-zA-Z][^\s>/]*+(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|[^<]+|<", re.S)
TAIL = re.compile(r"<!--.*|<!\[CDATA\[.*|[^<]+|<", re.S)  # behind the last mark that ends a tag
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements of the HTML standard by what they say of the text inside, and names that sites give to page furniture.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "select", "noframes", "xmp"}
# Of these, elements whose content is characters only: no tag or comment begins inside.
CHARACTERS = {"script", "style", "noscript", "textarea", "title", "iframe", "noframes", "xmp"}
ENDS = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in CHARACTERS}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
FURNITURE = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "head"}
LANDMARKS = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
# Whole names, in a class or an id, of boxes that are no article text; parts of other names do not count.
ADVERTS_AND_COMMENTS = re.compile(
    r"(?:user|reader|article|post|page|blog)?[-_]?comments?(?:[-_]?(?:list|thread|section|area|box|form|wrapper|container|body|block))?[-_]?\d*|commentlist|replies|reply|disqus(?:[-_]thread)?|respond"
    r"|(?:google|page|top|side|inline)?[-_]?(?:ads?|adverts?|advertisements?|advertising|adsense|sponsored)(?:[-_](?:box|slot|unit|container|banner|wrapper|block|area|label|top|bottom|left|right|middle|inline))?[-_]?\d*"
)
# Names that say the same inside a landmark; shorter ones (menu, notice, header) may name what an article is about.
COMPOUND = {
    "main-menu", "site-menu", "main-nav", "site-nav", "navbar", "nav-bar", "navigation", "sidebar", "side-bar", "site-header", "site-footer", "page-footer", "breadcrumb", "breadcrumbs", "cookie-notice", "cookie-banner", "cookie-consent", "cookies", "gdpr",
    "newsletter", "newsletter-signup", "share-buttons", "social-share", "pagination", "site-notice", "skip-link",
}
BOXES = COMPOUND | {
    "promo", "banner", "nav", "navbar", "navigation", "menu", "sidebar", "side-bar", "footer", "header", "masthead", "topbar", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "signup", "login", "share", "sharing", "social", "pagination", "pager", "widget", "toolbar", "site-header", "site-footer", "main-nav", "main-menu", "cookie-notice", "cookie-banner", "share-buttons", "newsletter-signup",
}
COMMENT = re.compile(r"(?:user|reader)?[-_]?comment(?:[-_]?\d*)?|reply")  # an article that is one
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "center", "details", "figure", "fieldset"}
OPEN, KEPT, DROPPED, TITLE, HEADER = 0, 1, 2, 3, 4  # TITLE: a first heading in a header, which is text where the page has no landmark


def names_a_box(tag: str, given: dict[str, str], outer: int) -> bool:
    """Whether an element names itself as something else than text.

    A container does by one whole name, another element if all its names are such. Inside a
    landmark only adverts, comments and COMPOUND names count.
    """
    known = COMPOUND if outer == KEPT else BOXES
    names = [x for key in ("class", "id") for x in given.get(key, "").lower().split()]
    return bool(names) and (any if tag in CONTAINERS else all)(x in known or ADVERTS_AND_COMMENTS.fullmatch(x) is not None for x in names)


def zone_of(tag: str, attributes: str, outer: int) -> int:
    """Zone of an element by its tag and attributes inside the outer zone."""
    if tag == "h1" and outer == HEADER:
        return TITLE
    if tag == "header" and outer == OPEN:
        return HEADER  # a header, in which a first heading may stay
    if outer == DROPPED or tag in FURNITURE or tag == "header" and outer != KEPT:
        return DROPPED
    given = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    role = given.get("role", "").lower()
    if tag not in ("body", "html") and tag not in LANDMARKS and (role in ROLES or "hidden" in given or UNSEEN.search(given.get("style", "")) or names_a_box(tag, given, outer)):
        return DROPPED
    if tag == "article" and any(COMMENT.fullmatch(x) for x in given.get("class", "").lower().split()):
        return DROPPED
    return outer if outer == HEADER else KEPT if tag in LANDMARKS or role == "main" or given.get("itemprop") == "articleBody" else outer


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's text blocks in order; furniture is left out."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()  # names on the stack
    zone, skip, last = OPEN, "", page.rfind(">")

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((zone, text))
            held = []

    at = 0
    while m := (TOKEN if at <= last else TAIL).match(page, at):
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            if not skip and zone not in (DROPPED, HEADER):
                held.append(token)
            continue
        if token[1] in "!?":
            continue
        closing = token[1] == "/"
        name = re.match(r"</?([a-zA-Z][^\s>/]*)", token)[1].lower()
        if name in CHARACTERS and not closing and not token.endswith("/>"):
            end = ENDS[name].search(page, at)
            if end:
                at = end.end()
            elif not skip:  # without an end it takes the rest of the page
                break
            continue
        if skip:
            if closing and name == skip:
                skip = ""
            continue
        if closing:
            if name in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    flush() if stack[i][1] != zone or zone != (stack[i - 1][1] if i else OPEN) else None
                    opened.subtract(x for x, _ in stack[i:])
                    del stack[i:]
                    break
            new = stack[-1][1] if stack else OPEN
            if new != zone:
                flush()
                zone = new
            continue
        if name in BLOCKS:
            flush()
            while stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in ("li", "tr", "td", "th", "dt", "dd", "option"))) and name != "br":
                opened[stack.pop()[0]] -= 1
            new = stack[-1][1] if stack else OPEN
            zone = new
        if name in VOID or token.endswith("/>"):
            if name == "br" or name == "hr":
                held.append(" ")
            continue
        if name in RAW:
            skip = name
            continue
        new = zone_of(name, token[1 + len(name) : -1], zone)
        if new != zone:
            flush()
            zone = new
        stack.append((name, zone))
        opened[name] += 1
    flush()
    if any(z == KEPT for z, _ in out):
        return [(z, t) for z, t in out if z != TITLE]
    return [(OPEN, t) for _, t in out]


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path, without what does not tell pages apart."""
    try:
        parts = urlsplit((url or "").strip())
        host, path = (parts.hostname or "").removeprefix("www."), parts.path
    except ValueError:
        host, path = "", url or ""
    return host, re.sub(r"(/|/?index\.html?|\.html?)$", "", path)


PARSED = "rid long, page_id long, url string, host string, path string, landmark boolean, zones array<int>, lines array<string>, open array<long>, chars array<int>, content long"


def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = TaskContext.get().partitionId() << 33
    for part in parts:
        rows = []
        for page, url, text in zip(part["page_id"], part["url"], part["html"], strict=True):
            found = blocks_of(text or "")
            chars = [len(t) for z, t in found if z == OPEN]
            hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for z, t in found if z == OPEN]
            host, path = url_key(url)
            rows.append((n, None if pd.isna(page) else int(page), url, host, path, any(z == KEPT for z, _ in found), [z for z, _ in found], [t for _, t in found], hashes, chars, xxhash.xxh3_64_intdigest(np.array(hashes, np.int64).tobytes()) - 2**63))
            n += 1
        yield pd.DataFrame(rows, columns=["rid", "page_id", "url", "host", "path", "landmark", "zones", "lines", "open", "chars", "content"]).astype({"page_id": "Int64"})


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of a that lie on a longest common subsequence of a and b.

    Equal ends are cut off; the rest goes by bit-parallel rows, and is halved where the
    rows would take much memory.
    """
    n = min(len(a), len(b))
    head = n if np.array_equal(a[:n], b[:n]) else int(np.argmax(a[:n] != b[:n]))
    n -= head
    tail = 0
    while tail < n and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    inner = np.intersect1d(x, y)
    keep_x, keep_y = np.flatnonzero(np.isin(x, inner)), np.flatnonzero(np.isin(y, inner))
    got = keep_x[_match(x[keep_x].tolist(), y[keep_y].tolist())] + head
    return np.concatenate((np.arange(head), got, np.arange(len(a) - tail, len(a)))).astype(int)


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """Bit j of the i-th row is 0 where the LCS of x[:i + 1] and y[:j + 1] exceeds that of y[:j]."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _match(x: list[int], y: list[int]) -> list[int]:
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) > 1 << 28:
        half = len(x) // 2
        for front in _rows(x[:half], y):
            pass
        for back in _rows(x[half:][::-1], y[::-1]):
            pass
        grow = lambda row: np.concatenate(([0], np.cumsum(1 - np.array(list(map(int, f"{row:0{len(y)}b}"[::-1])))))) if y else np.zeros(1)
        cut = int(np.argmax(grow(front) + grow(back)[::-1]))
        return _match(x[:half], y[:cut]) + [half + i for i in _match(x[half:], y[cut:])]
    rows = list(_rows(x, y))
    out, j = [], len(y) - 1
    for i in range(len(x) - 1, -1, -1):
        while j >= 0 and rows[i] >> j & 1:  # no growth at j: the match lies before
            j -= 1
        if j < 0:
            break
        if i == 0 or rows[i - 1] >> j & 1:
            out.append(i)
            j -= 1
    return out[::-1]


class Page(NamedTuple):
    """Open lines of a page; left is false for the lines that are common to the host."""

    rid: int
    host: str
    landmark: bool
    open: np.ndarray
    chars: np.ndarray
    left: np.ndarray


def is_copy(page: Page, got: np.ndarray) -> bool:
    """Whether the lines at got, which another page shares, make it a copy of the page."""
    left, chars = page.left, page.chars
    if chars[left].sum() <= LITTLE * chars.sum():
        left = np.ones(len(left), bool)
    shared = left[got]
    return 2 * shared.sum() >= left.sum() and chars[got][shared].sum() >= COPY * chars[left].sum()


class Different:
    """The last pages of a host of which none is a copy of another."""

    def __init__(self) -> None:
        self.pages: list[Page] = []

    def meet(self, page: Page, wanted: int = NEAR, join: bool = True) -> tuple[set[int], int]:
        """Lines of the page that the nearest of these show to be shared, and how many showed it; it then joins them."""
        if self.pages and self.pages[-1].host != page.host:
            self.pages = []
        shared: set[int] = set()
        met, copies = 0, []
        for i in range(len(self.pages) - 1, -1, -1):
            if met >= wanted and not join:
                break
            other = self.pages[i]
            got = common(page.open, other.open)
            copy = is_copy(page, got)
            if copy:
                copies.append(i)
            if met < wanted and (not copy or page.landmark):
                shared.update(got.tolist())
                met += 0 if copy else 1
        if join:
            self.pages = [p for i, p in enumerate(self.pages) if i not in copies][-NEAR:] + [page]
        return shared, met


#: Pages in order; rid, the place in the input, tells only pages apart that are equal in all these.
ORDER = ["host", "path", "url", "page_id", "content", "rid"]
LIGHT = ["rid", "host", "landmark", "open", "chars", "left"]
PAIRED = "rid long, shared array<int>, host string, landmark boolean, open array<long>, chars array<int>, left array<boolean>, need int, pid int, place int"
RESULT, UNMET, LAST = 0, -1, -2  # rows of paired by place: lines found, pages with too few before them, last different pages


def page_of(row: tuple) -> Page:
    rid, host, landmark, lines, chars, left = row
    return Page(int(rid), host, bool(landmark), np.asarray(lines, np.int64), np.asarray(chars, np.int64), np.asarray(left, bool))


def as_rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[f.split()[0] for f in PAIRED.split(", ")])


def pair_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of a partition against different pages before them; what else the second pass needs."""
    pid, before, first = TaskContext.get().partitionId(), Different(), None
    for part in parts:
        out: list[tuple] = []
        for row in zip(*(part[c] for c in LIGHT), strict=True):
            page = page_of(row)
            if first is None:
                first = page.host
            shared, met = before.meet(page)
            if shared:
                out.append((page.rid, sorted(shared), None, None, None, None, None, 0, pid, RESULT))
            if met < NEAR and page.host == first and pid:
                out.append((page.rid, None, page.host, page.landmark, page.open, page.chars, page.left, NEAR - met, pid, UNMET))
        if out:
            yield as_rows(out)
    if before.pages:
        yield as_rows([(p.rid, None, p.host, p.landmark, p.open, p.chars, p.left, i, pid, LAST) for i, p in enumerate(before.pages)])


def carried(last: pd.DataFrame) -> dict[int, list[Page]]:
    """The different pages that lie before each partition, by those that each partition ends with."""
    out: dict[int, list[Page]] = {}
    now = Different()
    rows = {pid: part.sort_values("need") for pid, part in last.groupby("pid")}
    for pid in sorted(rows):
        out[pid] = list(now.pages)
        for row in rows[pid][LIGHT].itertuples(index=False, name=None):
            now.meet(page_of(row))
    return out


def meet_carried(shared):
    """Pages that met too few within their partition, against the last pages of those before."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for part in parts:
            rids, found = [], []
            for need, pid, *row in part[["need", "pid", *LIGHT]].itertuples(index=False, name=None):
                before = Different()
                before.pages = of.get(pid, [])
                lines, _ = before.meet(page_of(tuple(row)), int(need), join=False)
                if lines:
                    rids.append(int(row[0]))
                    found.append(sorted(lines))
            yield pd.DataFrame({"rid": pd.Series(rids, dtype="int64"), "shared": pd.Series(found, dtype=object)})

    return run


def walk(keys: DataFrame, down: bool) -> DataFrame:
    """rid, shared: the lines of each page that different pages before it in the order show."""
    spark = keys.sparkSession
    order = [F.desc(c) if down else F.asc(c) for c in ORDER]
    ranged = keys.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(*LIGHT)
    paired = stage(ranged.mapInPandas(pair_up, PAIRED), "paired")
    last = paired.filter(F.col("place") == LAST).select("pid", "need", *LIGHT).toPandas()  # a few pages a partition
    across = paired.filter(F.col("place") == UNMET).select("need", "pid", *LIGHT).mapInPandas(meet_carried(spark.sparkContext.broadcast(carried(last))), "rid long, shared array<int>")
    return paired.filter(F.col("place") == RESULT).select("rid", "shared").unionByName(across)


def common_lines(parsed: DataFrame) -> DataFrame:
    """site, lines: of each host the lines on at least COMMON different pages and on half of them."""
    pages = parsed.filter(F.size("open") > 0).select(F.xxhash64("host").alias("site"), F.xxhash64("path").alias("path"), "content", "open")
    different = F.least(F.count_distinct("path"), F.count_distinct("content"))
    total = stage(pages.groupBy("site").agg(different.alias("pages")).filter(F.col("pages") >= COMMON), "sites")
    lines = pages.select("site", "path", "content", F.explode(F.array_distinct("open")).alias("line"))
    often = stage(lines.groupBy("site", "line").agg(different.alias("m")).filter(F.col("m") >= COMMON), "often")
    return stage(often.join(total, "site").filter(F.col("m") * 2 >= F.col("pages")).groupBy("site").agg(F.collect_list("line").alias("common")), "common")


FINAL = "page_id long, url string, text string, n_chars long, n_shared int"


def assemble(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for page, url, zones, lines, shared in zip(part["page_id"], part["url"], part["zones"], part["lines"], part["shared"], strict=True):
            gone = set(shared) if shared is not None else set()
            text, k = [], 0
            for z, t in zip(zones, lines, strict=True):
                if z == OPEN:
                    k += 1
                if z == KEPT or k - 1 not in gone:
                    text.append(t)
            text = " ".join(text)
            rows.append((None if pd.isna(page) else int(page), url, text, len(text), len(gone)))
        yield pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars", "n_shared"]).astype({"page_id": "Int64"})


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared of every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    prepare(spark)
    given = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    with scratch(spark) as keep:
        parsed = keep(given.mapInPandas(parse, PARSED), "parsed")
        shared = keep(shared_of(parsed), "shared")
    return parsed.join(shared, "rid", "left").select("page_id", "url", "zones", "lines", "shared").mapInPandas(assemble, FINAL)


def shared_of(parsed: DataFrame) -> DataFrame:
    """rid, shared: indices of the open lines of each page that different pages near it share."""
    pages = parsed.filter(F.size("open") > 0).select(*ORDER, "landmark", "open", "chars", F.xxhash64("host").alias("site"))
    left = F.transform("open", lambda x: ~F.coalesce(F.array_contains("common", x), F.lit(False)))
    keys = stage(pages.join(common_lines(parsed), "site", "left").select(*ORDER, "landmark", "open", "chars", left.alias("left")), "keys")
    every = walk(keys, False).unionByName(walk(keys, True))
    return every.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))


def op9_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
