"""Main text of web pages by nearest-URL page differencing, checked by page structure.

A page's markup is scanned once into lines: the visible text blocks in page order. Pages
are paired with the page of nearest URL path within their host, the two pages' lines are
aligned by longest common subsequence, and lines that both share are template text and are
deleted. Neighbours that share most of their text may be copies, or pages of a long template:
they form a run, and every page of a run is compared with the pages before and after the run,
whatever its length (where the run is the whole host, with the run's first and last page).
Only a pair that leaves one page nearly nothing of its own is taken as copies and shows nothing.

An exact check follows, by the element that a line stands in. Lines in elements that are
never article text (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, by tag, role, class or id) go also where they differ between the pages. Where a
page marks its article (or main) element, and this holds most of the other text, the lines inside it stay, shared ones too (two
articles that quote one passage), and lines outside go. Elsewhere differencing decides.

Rows that are alike in url and html are one class. Classes are differenced by hashes of their
lines (64 bits; two of a pair's lines that differ are taken as alike once in 10^19), sorted by host, path and class into ranges
that Spark cuts. Runs that end within a range are decided there. A run at a range's edge, or one
too long to be held, leaves its first and last page and those next to it; windows over rows
without lines tell which of these continue each other, and the run's pages meet the pages
before and after it in a join. So no text depends on where ranges end, a host, a
folder or a URL with a third of all pages is spread over many tasks, and nothing is gathered at the driver.

Defined cases: null or empty html gives the empty text; null urls count as one host; a
page alone on its host has no lines deleted as shared; repeated rows stay and have one
text; null ids pass through; pages without a line outside menus and the like have no text and
stand in no pair; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import HOT_KEYS, HOT_ROWS, saved, table

#: Lines of a run that a task holds; a longer one is decided after the ranges.
HELD_LINES = 1 << 20
#: Rows taken out of Arrow at once.
SLICE = 256
#: Share of the shorter page's characters from which neighbours are one run.
COPY = 0.8
#: Characters of its own that a copy has at most (a date, a counter).
OWN = 40

# Fixed lists of markup.
RAW = "script|style|noscript|template|svg|iframe|textarea|select|title|object|audio|video|canvas"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements whose ids inside an article name its parts.
TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a new one of the same set closes, up to the list or table they are in.
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body article main section div nav aside footer header form".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu footer "
    "cookie cookies consent notice banner popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended comment comments reply replies respond discussion breadcrumb breadcrumbs pagination pager masthead toolbar widget disclaimer".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s>/]).*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.IGNORECASE)

MAIN, BOILER, UNMARKED = 0, 1, 2


def _zone(tag: str, attrs: str, outer: int) -> int:
    if outer == BOILER:
        return BOILER
    if tag in BOILER_TAGS and not (tag == "header" and outer == MAIN):
        return BOILER
    if attrs:
        for name, *values in _NAMED.findall(attrs):
            words = "".join(values).lower()
            if name.lower() == "role":
                if words in BOILER_ROLES:
                    return BOILER
            elif outer == MAIN and name.lower() == "id" and tag in TITLED:
                continue  # an anchor of the article's own
            elif tag not in ("html", "body", *MAIN_TAGS) and not BOILER_NAMES.isdisjoint(re.split(r"[\s_-]+", words)):
                return BOILER
        if _HIDDEN.search(attrs):
            return BOILER
    return MAIN if tag in MAIN_TAGS else outer


def blocks(html: str) -> tuple[list[str], list[int], bool]:
    """Visible text blocks in page order, their zones, and whether an article is marked."""
    lines: list[str] = []
    zones: list[int] = []
    stack: list[tuple[str, int]] = []
    piece: list[str] = []
    zone, marked = UNMARKED, False

    def flush() -> None:
        if piece:
            text = "".join(piece)
            piece.clear()
            text = " ".join((references.unescape(text) if "&" in text else text).split())
            if text:
                lines.append(text)
                zones.append(zone)

    for m in _TOKEN.finditer(html):
        kind = m.lastgroup
        if kind == "text":
            piece.append(m["text"])
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            piece.append(" ")
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    outer = stack[k - 1][1] if k else UNMARKED
                    if outer != zone:
                        flush()
                    del stack[k:]
                    zone = outer
                    break
            continue
        if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCK_TAGS:
            continue
        closes = SELF_CLOSING.get(tag, ("p",) if tag in BLOCK_TAGS else ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in closes:
                del stack[k:]
                zone = stack[-1][1] if stack else UNMARKED
                break
            if stack[k][0] in SCOPES:
                break
        inner = _zone(tag, m["attrs"], zone)
        if inner != zone:
            flush()
        marked |= inner == MAIN
        stack.append((tag, inner))
        zone = inner
    flush()
    if marked:
        # A teaser card or an empty element is no article: it holds most of the other text.
        inside, outside = (sum(len(x) for x, at in zip(lines, zones) if at == wanted) for wanted in (MAIN, UNMARKED))
        if inside <= outside:
            zones, marked = [UNMARKED if at == MAIN else at for at in zones], False
    return lines, zones, marked


#: Bits that one alignment holds at once; longer ones are computed again in runs of rows.
HELD_BITS = 1 << 28


def common(a: list[str], b: list[str]) -> list[int]:
    """Places in a of one longest common subsequence of a and b.

    By bits (Hyyrö, 2004): after each line of a, an integer has a 0 for each line of b at which
    the longest common subsequence grows. A step costs len(b) / 64 operations, whatever lines
    repeat; the way back reads the integers in reverse, from rows kept at intervals."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    rows, width = a[head : len(a) - tail], len(b) - tail - head
    at: dict[str, int] = {}
    for j in range(width):
        at[b[head + j]] = at.get(b[head + j], 0) | 1 << j
    full = (1 << width) - 1

    def after(v: int, row: str) -> int:
        here = at.get(row)
        if not here:
            return v
        u = v & here
        return ((v + u) | (v - u)) & full

    middle: list[int] = []
    if rows and at:
        step = max(1, min(len(rows), HELD_BITS // width // 2))
        v, kept = full, []
        for i, row in enumerate(rows):
            if i % step == 0:
                kept.append(v)
            v = after(v, row)
        i, j = len(rows), width
        for block in range(len(kept) - 1, -1, -1):
            first = block * step
            held = [kept[block]]
            for row in rows[first : min(first + step, len(rows))]:
                held.append(after(held[-1], row))
            while i > first and j:
                # The last line of b so far at which the subsequence grows.
                j = (~held[i - first] & (1 << j) - 1).bit_length()
                if not j:
                    break
                while i > first and not held[i - 1 - first] >> (j - 1) & 1:
                    i -= 1
                if i == first:
                    break  # the row lies in an earlier block
                i, j = i - 1, j - 1
                middle.append(head + i)
            if not j:
                break
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def _shared_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


class Page(NamedTuple):
    """A page as differencing sees it: lines are their hashes, a weight is a line's characters,
    0 for a line that is never article text."""

    path: str
    lines: list
    weights: list[int]


def compare(page: Page, other: Page) -> tuple[float, bool, list[int]]:
    """Share of the shorter page that both have, whether the two are copies, the places in ``page``."""
    same = common(page.lines, other.lines)
    shared, least = sum(page.weights[n] for n in same), min(sum(page.weights), sum(other.weights))
    share = shared / max(1, least)
    return share, share >= COPY and least - shared <= OWN, same


def shared_lines(page: Page, before: Page | None, after: Page | None) -> list[int]:
    """Places of the lines that a page shares with that of the two pages around its run which
    shares less than COPY, or else least, and has the nearer URL. A side equal to the page says nothing."""
    sides = [(x, *compare(page, x)) for x in (before, after) if x and x[1:] != page[1:]]
    if not sides:
        return []
    _, _, copy, same = min(sides, key=lambda x: (x[1] if x[1] >= COPY else 0, -_shared_prefix(page.path, x[0].path)))
    if not copy:
        return same
    if len(sides) == 2 and sides[0][2] and sides[1][2] and not compare(before, after)[1]:
        # Two different pages hold all of this one, or it holds both: only what all three share.
        return sorted(set(sides[0][3]) & set(sides[1][3]))
    return []


class Ends(NamedTuple):
    """What is known in a range about a run that is not decided there."""

    number: int
    host: str
    at_start: bool
    at_end: bool
    pages: dict[str, Page]


def _scan(rows: Iterable[tuple], first_number: int, most_held: int = HELD_LINES) -> Iterator[tuple]:
    """Sorted rows (key, host, page) of one range: ("done", key, places), ("open", key, page,
    number of the run) or ("ends", Ends)."""
    run: list[tuple] = []
    held = number = 0
    first: Page | None = None
    last = left = host = None
    at_start = opened = False

    def close(right: Page | None, at_end: bool) -> Iterator[tuple]:
        if opened or at_end:
            for key, page in run:
                yield "open", key, page, first_number + number
            known = {"first": first, "last": last, "left": left, "right": right}
            yield "ends", Ends(first_number + number, host, at_start, at_end, {k: x for k, x in known.items() if x})
        else:
            sides = (left, right) if left or right else (first, last)
            for key, page in run:
                yield "done", key, shared_lines(page, *sides)

    for key, its_host, page in rows:
        if not any(page.weights):
            yield "done", key, []
            continue
        new_host = last is not None and its_host != host
        if last is None or new_host or compare(page, last)[0] < COPY:
            if last is not None:
                yield from close(None if new_host else page, False)
                number += 1
            left = None if new_host else last
            at_start = opened = last is None
            run, held, first, host = [], 0, page, its_host
        last = page
        run.append((key, page))
        held += len(page.lines)
        if opened or held > most_held:
            opened = True
            for its_key, its_page in run:
                yield "open", its_key, its_page, first_number + number
            run = []
    if last is not None:
        yield from close(None, True)


def article(lines: list[str], zones: list[int], marked: bool, shared: set[int]) -> str:
    """The lines that differencing leaves, after the check by structure."""
    return "\n\n".join(x for n, (x, zone) in enumerate(zip(lines, zones)) if (zone == MAIN if marked else zone == UNMARKED and n not in shared))


_LINES = [("lines", pa.list_(pa.int64())), ("weights", pa.list_(pa.int32()))]
_SIGNED = "k1 long, k2 long, host string, path string, lines array<long>, weights array<int>"
_SIGNED_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("host", pa.string()), ("path", pa.string()), *_LINES])
_SCANNED = "k1 long, k2 long, places array<int>, run long, side string, host string, at_start boolean, at_end boolean, path string, lines array<long>, weights array<int>"
_SCANNED_ARROW = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("places", pa.list_(pa.int32())), ("run", pa.int64()), ("side", pa.string()), ("host", pa.string()),
     ("at_start", pa.bool_()), ("at_end", pa.bool_()), ("path", pa.string()), *_LINES]
)
_PLACES = "k1 long, k2 long, places array<int>"
_PLACES_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("places", pa.list_(pa.int32()))])
_TEXTS = "page_id long, url string, text string, n_shared long"
_LINED = "page_id long, url string, k1 long, k2 long, lines array<string>, at array<int>"
_LINED_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("lines", pa.list_(pa.string())), ("at", pa.list_(pa.int32()))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, SLICE).columns))


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == SLICE:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _mapped(df: DataFrame, function, spark_schema: str, schema: pa.Schema) -> DataFrame:
    """Rows that ``function`` makes of an iterator of rows, a slice at a time."""
    return df.mapInArrow(lambda batches: _batches(function(_rows(batches)), schema), spark_schema)


def _keyed(web: DataFrame) -> DataFrame:
    content = (F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    return web.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64(*content).alias("k1"), F.xxhash64(F.lit(1), *content).alias("k2"))


def _signed(rows: Iterator[tuple]) -> Iterator[tuple]:
    for k1, k2, host, path, html in rows:
        lines, zones, _ = blocks(html or "")
        hashes = [xxhash.xxh3_64_intdigest(x) - 2**63 for x in lines]
        yield k1, k2, host, path, hashes, [0 if zone == BOILER else len(x) for x, zone in zip(lines, zones)]


def classes(web: DataFrame) -> DataFrame:
    """One row (k1, k2, host, path, lines, weights, n) for each url and html, lines as hashes."""
    place = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    rows = _keyed(web).select("k1", "k2", F.lower(F.substring_index(place, "/", 1)).alias("host"), place.alias("path"), "html")
    signed = _mapped(rows, _signed, _SIGNED, _SIGNED_ARROW)
    firsts = (F.first(c).alias(c) for c in ("host", "path", "lines", "weights"))
    return saved(signed.groupBy("k1", "k2").agg(*firsts, F.count("*").alias("n")), "pages-classes")


def _scanned(rows: Iterator[tuple], most_held: int) -> Iterator[tuple]:
    number = TaskContext.get().partitionId() << 32
    pages = (((k1, k2), host, Page(path, lines, weights)) for host, path, k1, k2, lines, weights in rows)
    for kind, *found in _scan(pages, number, most_held):
        if kind == "done":
            yield *found[0], found[1], None, None, None, None, None, None, None, None
        elif kind == "open":
            yield *found[0], None, found[2], None, None, None, None, *found[1]
        else:
            (ends,) = found
            for side, page in ends.pages.items():
                yield None, None, None, ends.number, side, ends.host, ends.at_start, ends.at_end, *page


def _continues(rows: Iterator[tuple]) -> Iterator[tuple]:
    for run, path, lines, weights, *other in rows:
        yield run, compare(Page(path, lines, weights), Page(*other))[0] >= COPY


def _partners(ends: DataFrame) -> DataFrame:
    """(run, before, after): the pages around the run of each open run's row, from the ends of all ranges."""
    page = F.struct("path", "lines", "weights")
    parts = ends.groupBy("run").agg(*(F.first(c).alias(c) for c in ("host", "at_start", "at_end")), F.max(F.col("side") == "left").alias("has_left"), F.max(F.col("side") == "right").alias("has_right"))
    along = Window.partitionBy("host").orderBy("run")
    back = Window.partitionBy("host").orderBy(F.desc("run"))
    # A range's last run and the next range's first one meet, if they are of one host.
    parts = parts.withColumn("prior", F.when(F.col("at_start") & F.lag("at_end").over(along), F.lag("run").over(along)))
    parts = saved(parts, "pages-parts")
    lasts = ends.where("side = 'last'").select(F.col("run").alias("prior"), *(F.col(c).alias(f"last_{c}") for c in ("path", "lines", "weights")))
    edges = parts.where("prior is not null").select("run", "prior").join(ends.where("side = 'first'").select("run", "path", "lines", "weights"), "run").join(lasts, "prior").drop("prior")
    joined = _mapped(edges, _continues, "run long, goes_on boolean", pa.schema([("run", pa.int64()), ("goes_on", pa.bool_())]))
    parts = parts.join(joined, "run", "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))

    def ref(run, side: str):
        return F.concat_ws(":", run, F.lit(side))

    following = F.lead("run").over(along)
    parts = parts.select(
        "host", "run", "goes_on", F.lead("goes_on", 1, False).over(along).alias("goes_further"),
        F.when(F.col("has_left"), ref(F.col("run"), "left")).when(F.col("prior").isNotNull(), ref(F.col("prior"), "last")).alias("left"),
        F.when(F.col("has_right"), ref(F.col("run"), "right")).when(F.lead("prior").over(along).isNotNull(), ref(following, "first")).alias("right"),
    )
    head = F.when(~F.col("goes_on"), F.struct("left", ref(F.col("run"), "first").alias("first")))
    tail = F.when(~F.col("goes_further"), F.struct("right", ref(F.col("run"), "last").alias("last")))
    parts = parts.select("run", F.last(head, True).over(along).alias("head"), F.last(tail, True).over(back).alias("tail"))
    whole = F.col("head.left").isNull() & F.col("tail.right").isNull()
    parts = parts.select("run", F.when(whole, F.col("head.first")).otherwise(F.col("head.left")).alias("a"), F.when(whole, F.col("tail.last")).otherwise(F.col("tail.right")).alias("b"))
    named = ends.select(F.concat_ws(":", "run", "side").alias("ref"), page.alias("page"))
    for ref_name, name in (("a", "before"), ("b", "after")):
        parts = parts.join(named.withColumnsRenamed({"ref": ref_name, "page": name}), ref_name, "left").drop(ref_name)
    return parts


def _decided(rows: Iterator[tuple]) -> Iterator[tuple]:
    for k1, k2, path, lines, weights, before, after in rows:
        sides = (x and Page(x["path"], x["lines"], x["weights"]) for x in (before, after))
        yield k1, k2, shared_lines(Page(path, lines, weights), *sides)


def differences(found: DataFrame, n_ranges: int | None = None, most_held: int = HELD_LINES) -> DataFrame:
    """(k1, k2, places): the lines that each of ``classes`` shares with its nearest page. The rows
    depend neither on the number of ranges nor on how many lines of a run a task holds."""
    keys = ("host", "path", "k1", "k2")
    ranged = found.repartitionByRange(n_ranges, *keys) if n_ranges else found.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys).select(*keys, "lines", "weights")
    scanned = saved(_mapped(ordered, lambda rows: _scanned(rows, most_held), _SCANNED, _SCANNED_ARROW), "pages-scanned")
    partners = _partners(scanned.where("side is not null"))
    undecided = scanned.where("run is not null and side is null").select("run", "k1", "k2", "path", "lines", "weights")
    late = _mapped(undecided.join(partners, "run").drop("run"), _decided, _PLACES, _PLACES_ARROW)
    return scanned.where("run is null").select("k1", "k2", "places").unionByName(late)


def _lined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The lines that may be article text, each with its place if differencing decides about it, else -1."""
    for page_id, url, html, k1, k2 in rows:
        lines, zones, marked = blocks(html or "")
        wanted = MAIN if marked else UNMARKED
        at = [n for n, zone in enumerate(zones) if zone == wanted]
        yield page_id, url, k1, k2, [lines[n] for n in at], [-1] * len(at) if marked else at


def _texts(rows: Iterator[tuple]) -> Iterator[tuple]:
    for page_id, url, lines, at, places in rows:
        shared = set(places)
        yield page_id, url, "\n\n".join(x for x, n in zip(lines, at) if n not in shared), len(shared)


_TEXTS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_shared", pa.int64())])


def main_texts(web: DataFrame, n_ranges: int | None = None, most_held: int = HELD_LINES) -> DataFrame:
    """(page_id, url, text, n_shared) of every row (page_id, url, html); ``n_shared`` counts the
    lines that the page shares with its nearest page, whatever the structure says of them.

    Rows meet their class's places by shuffle, those of hot classes (at most HOT_KEYS exist) where they are."""
    found = classes(web)
    places = differences(found, n_ranges, most_held)
    rows = _keyed(web)
    most = max(HOT_ROWS, (found.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = found.where(F.col("n") > most).select("k1", "k2")
    keys = ["k1", "k2"]
    if hot.isEmpty():
        met = _mapped(rows, _lined, _LINED, _LINED_ARROW).join(places, keys)
    else:
        few = F.broadcast(saved(places.join(F.broadcast(hot), keys, "left_semi"), "pages-hot"))
        there = _mapped(rows.join(F.broadcast(hot), keys, "left_semi").select(*rows.columns), _lined, _LINED, _LINED_ARROW).join(few, keys)
        rest = _mapped(rows.join(F.broadcast(hot), keys, "left_anti").select(*rows.columns), _lined, _LINED, _LINED_ARROW).join(places, keys)
        met = there.unionByName(rest)
    return _mapped(met.select("page_id", "url", "lines", "at", "places"), _texts, _TEXTS, _TEXTS_ARROW)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")
