"""HTML extraction: the main text of pages, told from boilerplate by structure and by differencing with the nearest URL's page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import hidden, shown, stored
from emberlog.operators.joins import attach

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
BLANKS = re.compile(r"\s+")

RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no part of an article's text, wherever they are; ``header`` counts outside of the article.
BESIDE = frozenset("nav footer aside form button select svg canvas object dialog menu head audio video math datalist".split())
MAIN = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = BESIDE | MAIN | HEADINGS | frozenset(
    "html body header p div li ul ol dl dt dd table thead tbody tfoot tr caption blockquote pre section figure figcaption hr address details summary fieldset center".split())
#: Words in class and id that name what stands beside an article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification alert comment comments commentlist disqus respond sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "topbar toolbar share sharing social related recommended recommendations newsletter subscribe signup login popup modal overlay pagination pager".split())
#: Words that stand beside those in names of containers; a name with any other word is the article's own.
CONTAINERS = frozenset(
    "area bar block body box btn button buttons card cards col column container content counter count entry feed form frame group header heading "
    "holder icon icons inner inline item items label layer link links list main outer panel post posts row section sections slot space "
    "story stories text thread title toggle top bottom left right unit widget widgets wrap wrapper zone site page global primary secondary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())


def _names_aside(value: str, in_main: bool, header: bool) -> bool:
    """Whether a class or id names something beside the text.

    One of its tokens is made of words of NAMES, beside which only words of CONTAINERS may stand inside of a main part:
    "share-buttons" is no text there, "social-history" is.
    """
    for token in value.split():
        words = [w.lower() for w in WORD.findall(token)]
        named = [w in NAMES or w == "header" and header for w in words]
        if any(named) and (not in_main or all(n or w in CONTAINERS for w, n in zip(words, named))):
            return True
    return False


def _aside(name: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element stands beside the text, and whether it is a main part."""
    beside, main = name in BESIDE or name == "header" and not in_main, name in MAIN
    if attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id") and name not in MAIN and name not in ("body", "html"):
                beside |= _names_aside(value, in_main, not in_main and name in ("div", "section"))
            elif key == "role":
                beside |= value.lower() in ROLES
                main |= value.lower() in ("main", "article")
            elif key == "itemprop":
                main |= value == "articleBody"
            elif key == "aria-hidden":
                beside |= value.lower() == "true"
            elif key == "style":
                beside |= "display:none" in value.replace(" ", "").lower()
            elif key == "hidden":
                beside = True
        if "hidden" in attributes.lower():  # an attribute without a value; what stands in quotes is none
            beside |= re.search(r"(?:^|\s)hidden(?:\s|/|$)", ATTRIBUTE.sub(" ", attributes), re.IGNORECASE) is not None
    return beside and not main, main


def blocks_of(html: str | None) -> list[tuple[str, bool]]:
    """The text blocks of a page that do not stand beside its text, in order, and whether each lies in a marked main part.

    Tags may be unclosed, stray or cut off. Character references are decoded, white space is one blank, empty blocks go.
    """
    html = html or ""
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, beside, main, header inside the article
    beside = main = heads = 0
    heading = False
    at = 0

    def flush() -> None:
        if held:
            text = BLANKS.sub(" ", unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, main > 0))

    def pop(to: int) -> None:
        nonlocal beside, main, heads
        while len(stack) > to:
            _, b, m, h = stack.pop()
            beside, main, heads = beside - b, main - m, heads - h

    def within(name: str, until: frozenset) -> int | None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                return k
            if stack[k][0] in until:
                return None
        return None

    while True:
        tag = TAG.search(html, at)
        upto = tag.start() if tag else len(html)
        if upto > at and not beside and (not heads or heading):
            held.append(html[at:upto])
        if not tag:
            break
        at = tag.end()
        name = tag[2] or tag[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name in BLOCK:
            flush()
            if name in HEADINGS:
                heading = not closing
        elif name in ("br", "td", "th", "option"):
            held.append(" ")
        if closing:
            k = within(name, frozenset())
            if k is not None:
                pop(k)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID:
            continue
        if name == "body":
            k = within("head", frozenset())
            if k is not None:
                pop(k)
        if name in BLOCK:  # a block ends an open paragraph, a list item the one before
            for open_ in ("p", name if name in ("li", "dt", "dd", "tr") else "p"):
                k = within(open_, frozenset(("div", "article", "main", "section", "ul", "ol", "table", "body")))
                if k is not None:
                    pop(k)
        b, m = _aside(name, attributes, main > 0)
        h = name == "header" and main > 0 and not b
        if b or m or h or name in BLOCK:
            stack.append((name, b, m, h))
            beside, main, heads = beside + b, main + m, heads + h
    flush()
    return out


def shared_lines(mine: list[int], theirs: list[int]) -> list[int]:
    """Places in ``mine`` of a longest common subsequence with ``theirs``.

    Equal ends are cut off first, then lines that the other page lacks. The rest is compared bit-parallel: a row of the
    dynamic programme is one integer; every 512th is kept, those between are computed again on the way back.
    """
    head, tail, short = 0, 0, min(len(mine), len(theirs))
    while head < short and mine[head] == theirs[head]:
        head += 1
    while tail < short - head and mine[-1 - tail] == theirs[-1 - tail]:
        tail += 1
    found = [*range(head), *range(len(mine) - tail, len(mine))]
    a = [(x, k) for k, x in enumerate(mine[head:len(mine) - tail], head)]
    b = theirs[head:len(theirs) - tail]
    both = {x for x, _ in a} & set(b)
    a, b = [x for x in a if x[0] in both], [x for x in b if x in both]
    if not a:
        return found
    where: dict[int, int] = {}
    for k, (x, _) in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full, stride = (1 << len(a)) - 1, 512

    def step(row: int, x: int) -> int:
        u = row & where[x]
        return (row + u | row - u) & full

    kept, row = [full], full
    for k, x in enumerate(b, 1):
        row = step(row, x)
        if k % stride == 0:
            kept.append(row)
    i, j = len(b), len(a)
    low, rows = -1, []
    while i and j:
        if not low <= i - 1 < low + len(rows) - 1 or low < 0:
            low = (i - 1) // stride * stride
            rows = [kept[low // stride]]
            for x in b[low:i]:
                rows.append(step(rows[-1], x))
        if rows[i - low] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if i and not rows[i - low] >> (j - 1) & 1:
                continue
            j -= 1
            found.append(a[j][1])
    return sorted(found)


def place_of(url: str | None) -> tuple[str | None, str]:
    """Host and path of a URL; no host if there is none."""
    m = URL.match(url or "")
    return (m[1].lower().rpartition("@")[2] or None, m[2]) if m else (None, "")


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _neighbours(rows: Iterator[dict]) -> Iterator[tuple[dict, list[int]]]:
    """For rows in order of host and path: each row and its lines shared with the nearer of the rows beside it on its host."""

    def near(row: dict, other: dict | None) -> int:
        return _common(row["path"], other["path"]) if other and row["host"] is not None and other["host"] == row["host"] else -1

    before, row = None, next(rows, None)
    while row is not None:
        after = next(rows, None)
        back, ahead = near(row, before), near(row, after)
        yield row, [] if max(back, ahead) < 0 else shared_lines(row["lines"], (before if back >= ahead else after)["lines"])
        before, row = row, after


def boilerplate(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, version, drop): of pages, the blocks shared with the nearest page of the host by URL path that are no main part.

    Pages of one host with equal blocks (re-crawls, mirrors, repeated rows) are one page, at the least of their paths: a page
    is compared with one that differs, and all its copies lose the same blocks. Pages are put in order of host and path over
    all tasks, so a host with a third of all pages is many tasks' work. Each page is aligned with the one before or after it
    on its host, whichever shares more of the path (the one before if equal). Pages at the border of two tasks, two from each end, are aligned in one further task: a few rows for each partition.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for u, h in zip(batch.column(2).to_pylist(), batch.column(3)):
                blocks = blocks_of(h.as_py())
                lines = [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in blocks]
                out.append((*place_of(u), lines, [m for _, m in blocks]))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(columns, kinds))],
                                             ["key", "version", "host", "path", "lines", "main"])

    shape = f"key {kind}, version long, host string, path string, lines array<long>, main array<boolean>"
    named = pages.select(F.col(key).alias("key"), F.xxhash64(url, html).alias("version"), F.col(url).alias("url"), F.col(html).alias("html"))
    lines = stored(named.mapInArrow(read, shape), "lines")
    distinct = lines.filter("host IS NOT NULL").groupBy("host", F.xxhash64("lines").alias("content")).agg(
        F.min("path").alias("path"), F.first("lines").alias("lines"), F.max(~F.exists("main", lambda m: m)).alias("plain"))
    order = ["host", "path", "content"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    schema = pa.schema([
        ("host", pa.string()), ("content", pa.int64()), ("path", pa.string()), ("lines", pa.list_(pa.int64())), ("plain", pa.bool_()),
        ("shared", pa.list_(pa.int32())), ("at_end", pa.bool_()), ("border", pa.bool_())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition: its rows but for the first and last, which are not settled here, and as border rows two from each end."""
        out, ends, recent, n = [], {}, [], -1
        for n, (row, shared) in enumerate(_neighbours(row for batch in batches for row in batch.to_pylist())):
            if n < 2:
                ends[n] = row
            recent.append((n, row, shared))
            if len(recent) == 3:
                out += [row | {"lines": [], "shared": shared, "at_end": False, "border": False} for n, row, shared in recent[:1] if n]
                del recent[0]
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        out += [row | {"lines": [], "shared": shared, "at_end": False, "border": False} for n, row, shared in recent[:-1] if n]
        ends |= {n: row for n, row, _ in recent}
        out += [row | {"shared": None, "at_end": k in (0, n), "border": True} for k, row in sorted(ends.items())]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _neighbours(row for batch in batches for row in batch.to_pylist())
        done = [row | {"lines": [], "shared": shared} for row, shared in rows if row["at_end"]]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    result = "host string, content long, path string, lines array<long>, plain boolean, shared array<int>, at_end boolean, border boolean"
    ordered = stored(distinct, "distinct").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    aligned = stored(ordered.mapInArrow(align, result), "aligned")
    borders = aligned.filter("border").repartition(1).sortWithinPartitions(*order).mapInArrow(settle, result)
    every = aligned.filter("not border").unionByName(borders)
    found = stored(every.filter("plain AND size(shared) > 0").select("host", "content", "shared"), "shared")
    plain = lines.filter(~F.exists("main", lambda m: m) & F.col("host").isNotNull()).select("key", "version", "host", F.xxhash64("lines").alias("content"))
    # both sides stored, so the rows of a page with many copies can be split
    return stored(plain, "plain").join(found, ["host", "content"]).select("key", "version", F.col("shared").alias("drop"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without ``html``, with the main ``text`` of each: its blocks in page order, joined by two line feeds.

    Blocks of menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles go by their elements,
    roles and names. If a page marks an article or a main part, its blocks are the text. Of other pages the blocks shared with
    the nearest page of the host go. A null or empty page has an empty text; a page without a host or alone on its host has no
    neighbour; pages of a host with equal blocks are one page; an empty table gives an empty one.
    """
    inner, names = hidden(pages)
    key_, url_, html_ = names[key], names[url], names[html]
    drops = stored(boilerplate(inner, key_, url_, html_).groupBy("key", "version").agg(F.first("drop").alias("_drop")), "drops")
    zero = F.lit(0).cast(pages.schema[key].dataType)
    marked = inner.withColumns({"_none": F.col(key_).isNull(), "_key": F.coalesce(F.col(key_), zero), "_version": F.xxhash64(url_, html_)})
    lookup = drops.select(F.col("key").isNull().alias("_none"), F.coalesce("key", zero).alias("_key"), F.col("version").alias("_version"), "_drop")
    joined = attach(marked, lookup, ["_none", "_key", "_version"], "left")

    @F.arrow_udf("string")
    def main_text(htmls: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for page, drop in zip(htmls, drops.to_pylist()):
            blocks = blocks_of(page.as_py())
            if any(m for _, m in blocks):
                kept = [t for t, m in blocks if m]
            else:
                gone = set(drop or [])
                kept = [t for k, (t, _) in enumerate(blocks) if k not in gone]
            out.append("\n\n".join(kept))
        return pa.array(out, pa.string())

    return shown(joined.withColumn("_text", main_text.asNondeterministic()(html_, "_drop")), names, {text: F.col("_text")}, without=html)
