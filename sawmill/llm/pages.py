"""Main text of web pages by differencing with the page of the nearest URL.

Every page becomes lines, one per block element.  Within a host, pages are ordered by URL path and URL, and
each is paired with the neighbour whose path shares the longer beginning.  A longest common
subsequence aligns the two pages' lines, and shared lines are deleted: menus, notices and footers repeat
from page to page.  A shared heading stays when the line below it does.

Differencing alone is wrong where there is no neighbour, where an advert differs from page to page, and
where two pages hold the same article.  So each line also carries what its elements say: lines of
menus, headers, footers, sidebars, notices, adverts, forms and reader comments go even when they aren't
shared, as do lines outside ``article`` and ``main`` elements on pages that have such lines.  Shared lines
inside them go too, unless the two pages' articles are copies: at least ``COPY`` of the shorter one's text
is shared.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser
from itertools import pairwise
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sawmill.llm.common import bounded_batches, col, partitions, text_of
from sawmill.llm.frames import pack_strings, unpack_strings

SHARD = 256  # pages of a range, on average
MAX_RANGES = 100_000  # beyond that ranges grow; memory doesn't, since ordered pages are read one after the other
SAMPLED = 4  # keys a range that its cuts are taken from
GROUP_PAGES = 4096  # pages that a task differences, on average

COPY = 0.5  # share of the shorter article from which on two articles are copies

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary
table tbody td tfoot th thead tr ul""".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg annotation annotation-xml canvas audio video textarea".split())
CHROME = frozenset("nav header footer aside form button select option dialog menu label input".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of class and id attributes that mark what isn't the article, and words that only say where it is.
MARKS = frozenset("""ad ads adv advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs
header masthead footer sidebar aside widget cookie cookies consent notice notices alert popup modal overlay newsletter subscribe
signup login share sharing social related recommended comment comments replies respond disqus pagination pager skip""".split())
PLACES = frozenset("site global top bottom left right primary secondary box bar block container wrapper list link links area slot unit section inner".split())
TITLES = frozenset(("header", "masthead"))
OPEN, MAIN_LINE, CHROME_LINE = b"o", b"m", b"c"
HEADING, PLAIN = b"h", b"p"


def marks(names: str) -> set[str]:
    """The marks among class and id names: a name counts when each of its words is a mark or says where it is
    (``cookie-banner``, ``site-header``), so ``has-sidebar`` and ``entry-header`` don't."""
    out: set[str] = set()
    for name in names.lower().split():
        words = set(re.split("[-_]+", name)) - {""}
        if words <= MARKS | PLACES:
            out |= words & MARKS
    return out


class State(NamedTuple):
    """What an element's ancestors and the element itself say."""
    tag: str = ""
    hidden: bool = False
    chrome: bool = False  # by tag or role
    marked: bool = False  # by class or id
    main: bool = False
    titles: bool = False  # only its headings belong to the article
    heading: bool = False


class Lines(HTMLParser):
    """Blocks of text in page order; each is (kind and whether a heading, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[State] = []
        self.parts: list[str] = []
        self.lines: list[tuple[bytes, str]] = []
        self.found = False  # whether an article or main element has begun

    def _state(self) -> State:
        return self.stack[-1] if self.stack else State()

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            at = self._state()
            kind = CHROME_LINE if at.chrome or at.marked or at.titles and not at.heading else MAIN_LINE if at.main else OPEN
            self.lines.append((kind + (HEADING if at.heading else PLAIN), text))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        at, got = self._state(), dict(attrs)
        role = (got.get("role") or "").lower()
        own = set() if tag in ("html", "body") else marks(f"{got.get('class') or ''} {got.get('id') or ''}")
        body = tag in MAIN or role == "main"
        head = at.main and (tag == "header" or bool(own) and own <= TITLES)
        # a mark on a wrapper says nothing of the page's first article; a later one, or one inside, may be a comment
        marked = not head and (bool(own) and not (body and not self.found) or at.marked and (self.found or not body))
        self.found |= body
        self.stack.append(State(tag, at.hidden or tag in HIDDEN or "hidden" in got or (got.get("aria-hidden") or "") == "true",
                                at.chrome or role in ROLES or tag in CHROME and not head, marked or head and at.marked,
                                at.main or body, at.titles or head, at.heading or tag in HEADINGS))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # a slash doesn't close other elements
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if not self._state().hidden:
            self.parts.append(data)

    def close(self):
        super().close()
        self._flush()


def page_lines(html: str) -> list[tuple[bytes, str]]:
    parser = Lines()
    parser.feed(html)
    parser.close()
    return parser.lines


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < min(len(a), len(b)) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    shared = {*range(lo), *range(len(a) - end, len(a))}
    places: dict = {}
    for j in range(len(b) - end - 1, lo - 1, -1):
        places.setdefault(b[j], []).append(j)  # descending, so a line of ``a`` is used once
    ends: list[int] = []  # least last place in ``b`` of a common subsequence of each length
    chain: list = []
    for i in range(lo, len(a) - end):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    at = chain[-1] if chain else None
    while at:
        shared.add(at[0])
        at = at[1]
    return shared


def _key(b) -> list[tuple]:
    """Sort keys of a batch's rows; code points compare as the UTF-8 bytes do that Spark sorts by."""
    return list(zip(*(b.column(c).to_pylist() for c in ("host", "path", "url_key", "order")), strict=True))


def _ends(cuts):
    """Keys → each range's smallest and largest key."""
    def run(batches):
        ends: dict[int, list] = {}
        for b in batches:
            for k in _key(b):
                at = ends.setdefault(bisect_right(cuts.value, k), [k, k])
                at[0], at[1] = min(at[0], k), max(at[1], k)
        for r, both in ends.items():
            yield pa.record_batch([pa.array([r] * 2, pa.int32()), *(pa.array([k[i] for k in both], t) for i, t in enumerate(
                (pa.string(), pa.string(), pa.string(), pa.int64())))], names=["range", "host", "path", "url_key", "order"])
    return run


def _neighbours(ends: list[tuple[int, tuple, tuple]]) -> dict[tuple, set[int]]:
    """For the pages at the ends of ranges (in order: range, first and last key), the other ranges whose end they neighbour."""
    out: dict[tuple, set[int]] = {}
    for (left, _, last), (right, first, _) in pairwise(ends):
        if last[0] and last[0] == first[0]:
            out.setdefault(last, set()).add(right)
            out.setdefault(first, set()).add(left)
    return out


def _parse(shared):
    """Pages → their lines in their range, and once more as a guest in each range whose end they neighbour."""
    def run(batches):
        cuts, also = shared.value
        for b in batches:
            rows, ranges, guest, blobs = [], [], [], []
            for i, (k, html) in enumerate(zip(_key(b), b.column("html").to_pylist(), strict=True)):
                blob = pack_strings([kind + text.encode("utf-8", "replace") for kind, text in page_lines(html)])
                for r in (bisect_right(cuts, k), *sorted(also.get(k, ()))):
                    guest.append(bool(rows) and rows[-1] == i)
                    rows.append(i)
                    ranges.append(r)
                    blobs.append(blob)
            some = b.select(["id", "url", "host", "path", "url_key", "order"]).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([*some.columns, pa.array(ranges, pa.int32()), pa.array(guest, pa.bool_()), pa.array(blobs, pa.binary())],
                                  names=[*some.schema.names, "range", "guest", "lines"])
    return run


def nearer(before: str | None, path: str, after: str | None) -> bool | None:
    """Whether the path after has the longer common beginning (the one before on a tie); None without neighbours."""
    if before is None or after is None:
        return None if before is after else before is None
    return len(commonprefix([path, after])) > len(commonprefix([before, path]))


def _text(before, page, after) -> str:
    """Main text of a page between its neighbours; each is (id, url, path, place, guest, lines)."""
    lines = page[5]
    near = [x if x and page[3][1] and x[3] == page[3] else None for x in (before, after)]
    choice = nearer(near[0] and near[0][2], page[2], near[1] and near[1][2])
    shared = set() if choice is None else shared_lines([x[2:] for x in lines], [x[2:] for x in near[choice][5]])
    main = [len(x) for x in lines if x[:1] == MAIN_LINE]
    if shared and main:
        both = sum(len(x) for k, x in enumerate(lines) if k in shared and x[:1] == MAIN_LINE)
        if both >= COPY * min(sum(main), sum(len(x) for x in near[choice][5] if x[:1] == MAIN_LINE)):
            shared = set()
    kept: list[bytes] = []
    below = False  # whether the line below stays: a shared heading stays with it
    for k in range(len(lines) - 1, -1, -1):
        x = lines[k]
        below = (k not in shared or below and x[1:2] == HEADING) and (x[:1] == MAIN_LINE or x[:1] == OPEN and not main)
        if below:
            kept.append(x[2:])
    return "\n\n".join(x.decode() for x in reversed(kept))


def _texts(id_type):
    """Ordered pages → their main texts; three pages are held at a time."""
    def batch(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.string()),
                                pa.array([r[2] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64())],
                               names=["id", "url", "text", "n_chars"])

    def run(batches):
        before = page = None
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("id", "url", "host", "path", "range", "guest", "lines")}
                after = (r["id"], r["url"], r["path"], (r["range"], r["host"]), r["guest"], unpack_strings(r["lines"]))
                if page and not page[4]:
                    rows.append((page[0], page[1], _text(before, page, after)))
                before, page = page, after
            if rows:
                yield batch(rows)
        if page and not page[4]:
            yield batch([(page[0], page[1], _text(before, page, None))])
    return run


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *,
              shard: int = SHARD) -> DataFrame:
    """One row per input row: ``id_col``, ``url``, ``text``, ``n_chars``.

    Blocks are joined by a blank line in page order; white space inside a block is one space.

    A null or empty page has an empty text.  Pages without a URL or whose URL has no host have no
    neighbour.  Pages of one URL are neighbours, ordered by a hash of their content; repeated rows are
    pages each.  An empty table gives an empty result.  Other columns are not read.

    Pages are cut into ranges of about ``shard`` pages by (host, path, URL, hash), which shape the
    work and never the result: the pages at a range's ends also go to the range beside it.  Only rows that
    are equal in all of these can't be cut apart.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    url = col(url_col).cast("string")
    base = pages.select(col(id_col).alias("id"), url.alias("url"), text_of(html_col).alias("html"),
                        F.coalesce(url_host(url), F.lit("")).alias("host"), F.coalesce(url_path(url), F.lit("")).alias("path"),
                        F.coalesce(url, F.lit("")).alias("url_key"))
    base = base.withColumn("order", F.xxhash64("id", "html"))
    id_type = base.schema["id"]
    key = ("host", "path", "url_key", "order")
    n = base.count()
    ranges = min(n // shard + 1, MAX_RANGES)
    # at most about SAMPLED keys a range go to the driver
    some = base.where(F.pmod("order", F.lit(max(1, n // (SAMPLED * ranges)))) == 0).select(*key).distinct()
    picked = sorted(_key(some.toArrow()))
    cuts = picked[len(picked) // ranges or 1::len(picked) // ranges or 1]
    shared = spark.sparkContext.broadcast(cuts)
    ends = (base.select(*key).mapInArrow(_ends(shared), "range int, host string, path string, url_key string, order long")
            .groupBy("range").agg(F.min(F.struct(*key)).alias("first"), F.max(F.struct(*key)).alias("last")).collect())
    also = _neighbours(sorted((r["range"], tuple(r["first"]), tuple(r["last"])) for r in ends))
    parsed = base.mapInArrow(_parse(spark.sparkContext.broadcast((cuts, also))), T.StructType([
        id_type, *(T.StructField(c, T.StringType()) for c in ("url", "host", "path", "url_key")), T.StructField("order", T.LongType()),
        T.StructField("range", T.IntegerType()), T.StructField("guest", T.BooleanType()), T.StructField("lines", T.BinaryType())]))
    parts = max(4 * partitions(spark), min(n // GROUP_PAGES, MAX_RANGES // 4))
    out = (parsed.repartition(parts, "range").sortWithinPartitions("range", *key)
           .mapInArrow(_texts(to_arrow_type(id_type.dataType)), T.StructType([
               id_type, T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])))
    return out.withColumnRenamed("id", id_col)
