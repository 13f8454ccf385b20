"""Main text of HTML pages: page structure, then differencing with the page of the nearest URL."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwright.session import bound_batches

RESULT = "page_id bigint, url string, text string"
#: Pages on either side, in the order of host and path, that a page may be compared with.
NEAR = 2
#: A line of this many characters is running text rather than a menu's: if most such lines agree, two pages are copies.
LONG_LINE = 40
#: Bytes of html in a range of pages, and the most ranges: the driver holds NEAR keys of each end of each.
RANGE_BYTES = 64 << 20
MAX_RANGES = 20_000
#: Rows and characters of a batch that a task passes on.
BATCH_ROWS, BATCH_CHARS = 256, 4 << 20
_KEY = "host string, path string, page_id bigint, tie bigint"
_KEYS = ["host", "path", "page_id", "tie"]
_PARSED = f"g int, guest boolean, {_KEY}, url string, texts array<string>, zones array<int>"

#: Elements of HTML by what they do to the text.
SILENT = {"script", "style", "template", "noscript", "svg", "iframe", "object", "canvas", "head", "title", "select", "button", "textarea", "math", "audio", "video"}
ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu"}
MAIN = {"article", "main"}
BREAKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
SPACES = {"br", "td", "th", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id and role that mark what is no article text.
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|side|widget|footer|masthead|comments?|disqus|respond|share|sharing|social|related|recommended|newsletter|subscribe|contentinfo|complementary|search)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Zones of a block: of what surrounds the article, of neither, and from 0 up of an article, by how many marked elements stand around that.
ASIDE_ZONE, UNKNOWN, ARTICLE = -2, -1, 0


def _marks(attributes: str) -> bool:
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true") or ASIDE_WORDS.search(value):
            return True
    return False


class _Open(NamedTuple):
    """An open element, with what holds inside it: inside an aside element, inside an article, inside a marked element since, marked ones in all, and before the article."""

    name: str
    aside: bool = False
    article: bool = False
    marked: bool = False
    n_marked: int = 0
    level: int = 0
    n_zones: int = 0

    def zone(self) -> int:
        return ASIDE_ZONE if self.aside or self.marked else self.level if self.article else UNKNOWN


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block of text of the page, in order. Each tag takes a time that does not depend on the depth.

    An article inside an element whose class or id holds a listed word is still one: such words also name layouts.
    """
    out, parts, stack, at = [], [], [_Open("")], 0
    places: dict[str, list[int]] = {}
    unclosed: set[str] = set()
    now = UNKNOWN

    def end_block() -> None:
        if text := " ".join("".join(parts).split()):
            out.append((text, now))
        parts.clear()

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().name].pop()

    while True:
        match = TOKEN.search(page, at)
        parts.append(html.unescape(page[at : match.start() if match else len(page)]))
        if not match:
            break
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if not match[1] and name in SILENT:
            # Their content is no text; it ends at their own end tag, or never.
            if name not in unclosed and not match[3].rstrip().endswith("/"):
                found = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = found.end() if found else at
                if not found:
                    unclosed.add(name)
            continue
        if name in BREAKS:
            end_block()
        elif name in SPACES:
            parts.append(" ")
        if name in VOID:
            continue
        top = stack[-1]
        if match[1]:
            if places.get(name):
                k = places[name][-1]
                # A stray end tag of an inner element does not close a zone around it.
                if name in BREAKS or top.n_zones == stack[k - 1].n_zones:
                    close(k)
        else:
            if name == "p" and top.name == "p":
                close(len(stack) - 1)  # a paragraph ends where the next begins
                top = stack[-1]
            if name in MAIN:
                new = top._replace(name=name, article=True, marked=_marks(match[3]) and name == "article", level=top.n_marked, n_zones=top.n_zones + 1)
            elif name in ASIDE or (name == "header" and not top.article):
                new = top._replace(name=name, aside=True, n_zones=top.n_zones + 1)
            elif name not in ("body", "html") and _marks(match[3]):
                new = top._replace(name=name, marked=True, n_marked=top.n_marked + 1, n_zones=top.n_zones + 1)
            else:
                new = top._replace(name=name)
            places.setdefault(name, []).append(len(stack))
            stack.append(new)
        now = stack[-1].zone()
    end_block()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in `a` of a longest common subsequence of lines (Hunt and Szymanski, between what both begin and end with)."""
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    end = 0
    while end < most - low and a[-1 - end] == b[-1 - end]:
        end += 1
    found = {*range(low), *range(len(a) - end, len(a))}
    where: dict[str, list[int]] = {}
    for j in range(low, len(b) - end):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(low, len(a) - end):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            tails[k : k + 1], links[k : k + 1] = [j], [link]
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def main_text(own: list[tuple[str, int]], others: list[list[tuple[str, int]]]) -> str:
    """Blocks of the articles with the fewest marked elements around; on a page without one, blocks of no known zone that a near page does not share.

    `others` are the near pages, the nearest first. The first with such blocks that is no copy decides: one with
    which most long lines agree tells nothing of what surrounds the text.
    """
    level = min((z for _, z in own if z >= ARTICLE), default=None)
    if level is not None:
        return "\n\n".join(t for t, z in own if z == level)
    lines = [t for t, z in own if z == UNKNOWN]
    long = {k for k, t in enumerate(lines) if len(t) >= LONG_LINE}
    for other in others:
        around = [t for t, z in other if z == UNKNOWN]
        shared = shared_lines(lines, around)
        if around and own != other and 2 * len(long & shared) <= len(long):
            return "\n\n".join(t for k, t in enumerate(lines) if k not in shared)
    return "\n\n".join(lines)


def common_prefix(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def nearest_first(path: str, before: list, after: list) -> list:
    """The blocks of (path, blocks) rows before a page, the last next to it, and after it: longest shared beginning of the path first, then by distance, then the earlier."""
    ranked = [(-common_prefix(path, p), distance, side, found)
              for side, rows in enumerate((reversed(before), after)) for distance, (p, found) in enumerate(rows)]
    return [found for *_, found in sorted(ranked, key=lambda r: r[:3])]


def _order(host: str, path: str, page_id: int | None, tie: int) -> tuple:
    return host, path, page_id is not None, page_id or 0, tie


def ranges(rows: DataFrame, n: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """(the first keys of at most `n` ranges of `rows`, ranges that a key at an end of another one is needed in, too)."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = [], []
        for batch in batches:
            if len(first) < NEAR:
                first += batch.slice(0, NEAR).to_pylist()
            last = (last + batch.slice(max(0, batch.num_rows - NEAR)).to_pylist())[-NEAR:]
        found = [{**r, "is_first": is_first} for is_first, some in ((True, first[:NEAR]), (False, last)) for r in some]
        if found:
            part = [{"part": str(_order(*[first[0][k] for k in _KEYS])), **r} for r in found]
            yield pa.RecordBatch.from_pylist(part, pa.schema([("part", pa.string()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("tie", pa.int64()), ("is_first", pa.bool_())]))

    ordered = rows.select(*_KEYS).repartitionByRange(n, *_KEYS).sortWithinPartitions(*_KEYS)
    parts: dict[str, tuple[list, list]] = {}
    for r in ordered.mapInArrow(ends, f"part string, {_KEY}, is_first boolean").collect():
        parts.setdefault(r["part"], ([], []))[0 if r["is_first"] else 1].append(_order(*[r[k] for k in _KEYS]))
    inside = sorted((sorted(first), sorted(last)) for first, last in parts.values())
    guests: dict[tuple, set[int]] = {}
    before: list[tuple] = []
    for g, (_, last) in enumerate(inside):
        for key in before:
            guests.setdefault(key, set()).add(g)
        before = (before + last)[-NEAR:]
    after: list[tuple] = []
    for g, (first, _) in reversed(list(enumerate(inside))):
        for key in after:
            guests.setdefault(key, set()).add(g)
        after = (first + after)[:NEAR]
    return [first[0] for first, _ in inside], {key: sorted(at) for key, at in guests.items()}


def extract(pages: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """(page_id, url, text) of `pages`.

    Pages are ordered by host and URL path and dealt to ranges of that order, so a host that holds a third of all
    pages spreads over many tasks; the pages at the ends of a range go to its neighbours, too, so the result does
    not depend on the ranges. Each page is compared with the page on its host whose path shares the longest
    beginning, among the NEAR before and after it (the nearer, then the earlier one on a tie), that is no copy:
    one with the same blocks, or with which most lines of LONG_LINE characters agree, is passed over, as is a page all
    of whose text is article or aside. Lines that
    both share, by longest common subsequence, go. Blocks inside an article or main element are the article by the
    page's own word: they stay even if another page has them too. Keys of the range ends, 2 * NEAR a range, are all
    that the driver holds. Defined results: null and empty html give an empty text; a null url is a host of its
    own; repeated rows each give a row; a page alone on its host, or among copies alone, loses nothing to
    differencing; other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[?#].*$", "")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.regexp_extract(bare, "^[^/]*", 0).alias("host"),
                        F.regexp_replace(F.regexp_replace(bare, "^[^/]*", ""), r"(?:/|\.html?)$", "").alias("path"), F.xxhash64("url", "html").alias("tie"))
    if n_ranges is None:
        n_bytes = pages.agg(F.sum(F.octet_length("html"))).head()[0] or 0
        n_ranges = min(MAX_RANGES, max(spark.sparkContext.defaultParallelism, -(-n_bytes // RANGE_BYTES)))
    ends = spark.sparkContext.broadcast(ranges(rows, n_ranges))
    schema = pa.schema([("g", pa.int32()), ("guest", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("tie", pa.int64()),
                        ("url", pa.string()), ("texts", pa.list_(pa.string())), ("zones", pa.list_(pa.int32()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, guests = ends.value
        out, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                key = [row[k] for k in _KEYS]
                found = blocks(row["html"] or "")
                texts, zones = [t for t, _ in found], [z for _, z in found]
                own = bisect_right(firsts, _order(*key)) - 1
                for g in {own, *guests.get(_order(*key), ())}:
                    out.append((g, g != own, *key, row["url"], texts, zones))
                    held += sum(map(len, texts))
                if len(out) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield _packed(out, schema)
                    out, held = [], 0
        yield _packed(out, schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed():
            for batch in batches:
                for r in batch.to_pylist():
                    yield r["g"], r["host"], r["path"], list(zip(r["texts"], r["zones"], strict=True)), None if r["guest"] else (r["page_id"], r["url"])
            yield from [None] * (NEAR + 1)

        window, done, held = [None] * (2 * NEAR + 1), [], 0
        for row in parsed():
            window = [*window[1:], row]
            own = window[NEAR]
            if own and own[4]:
                near = [[(p[2], p[3]) for p in some if p and p[:2] == own[:2]] for some in (window[:NEAR], window[NEAR + 1 :])]
                done.append((*own[4], main_text(own[3], nearest_first(own[2], *near))))
                held += len(done[-1][2])
                if len(done) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield _packed(done, result)
                    done, held = [], 0
        yield _packed(done, result)

    result = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    dealt = rows.mapInArrow(parse, _PARSED).repartitionById(max(1, len(ends.value[0])), "g").sortWithinPartitions("g", *_KEYS, "guest")
    return dealt.mapInArrow(compare, RESULT)


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(schema)], schema=schema)
