"""Main text of web pages: nearest-URL page differencing of all lines, then what markup names.

A page is cut into lines of text, those of menus, headers and footers as well (scripts, styles and form fields
hold none). Pages are then ordered by
host and URL path, each is paired with the neighbour of its host whose path shares the longest
beginning, and the two lists of lines are aligned by a longest common subsequence; what both
share is the site's frame and goes. A line inside an ``article`` or ``main`` element is article
text by its markup, so it stays if only some other pages quote it; it goes if the neighbour shares
it and it stands on at least ``COMMON`` of the different pages of the host, three at least. Pages of
a host with the same lines are one page. A page that shares four fifths of the lines outside frames may be a near copy, so only
such common lines and those of frames go by it, and the next nearest within ``NEAR`` places on either side is tried.

Differencing can't see frames that differ from page to page, such as menus of current topics, reader comments and
adverts. So of the lines that are left, those in navigation, headers, footers, asides, forms and
elements whose class, id or role names such a thing go, too.
``article`` and ``main`` elements are the body only if they hold at least half of the unlinked
text outside frames; else all lines outside frames stay. ``article`` elements whose class, id
or role names a frame (related cards) are left out unless they hold most of the text.
Within ``article`` and ``main``, and for headings and paragraphs anywhere, a word that is only a part of a class name
(``banner-title``, ``social-history``) cuts nothing: the whole name must be made of such words and of ones like ``box`` or ``list``.

Broken markup is read with tolerance: a quote that nothing closes ends with its tag, a tag that the page breaks off in is left out, an element such as
``select``, ``video`` or ``textarea`` that is never closed hides no more than its own tag (its options, for ``select``), and the text in an
``object`` counts. Only ``script``, ``style`` and comments run to the end of the page, as in browsers.

Only hashes of lines travel: one pass writes them, the pairs are found in blocks of
``RUN`` neighbours in the order of URLs (with ``NEAR`` pages of the next block on either side, so the
result doesn't depend on how rows are dealt out), and a second pass over the pages leaves
out the lines found.

Defined cases: a page of any length is read whole; of two neighbours whose paths are equally near the one fewer places away
counts, then the earlier one; a null or empty page has an empty text and 0 characters; a null or odd url is
a host of its own kind and still gets a row; an empty table gives no rows; a repeated row is
reported each time; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.shared import materialise, small_batches

RUN, NEAR = 64, 4
#: A line outside articles and frames, one of an article, one that the markup names a part of the frame.
PLAIN, HELD, FRAMED = 0, 1, 2
#: Share of its lines outside frames that makes a page a copy of another.
COPY = 0.8
#: Lists of lines to leave out that are broadcast at most.
BROADCAST_ROWS = 100_000
#: Share of a host's different pages on which a line of an article is the site's, and their least number.
COMMON, LEAST_PAGES = 0.8, 3

# HTML element names by what they mean for text.
SILENT = set("script style noscript template svg math iframe textarea canvas audio video".split())
TO_THE_END, UNNESTED = {"script", "style"}, {"iframe", "textarea", "canvas", "audio", "video"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split()
)
FRAME = set("nav footer aside form head title button dialog menu select optgroup option".split())
MAIN = {"article", "main"}
CHOICES = {"select", "optgroup", "option"}
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
# Words in class, id or role that name the frame of a page.
FRAME_WORDS = set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer sidebar aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login register search searchbox "
    "share sharing social related recommended comment comments respond reply replies disqus discussion pagination pager toolbar skip masthead topbar "
    "complementary contentinfo dialog outbrain taboola".split()
)
HEADER_WORDS = {"header", "hdr", "branding", "logo"}
# Words that a class name has beside those of frames without meaning anything else, and ones that tell of a state.
CARRIERS = set(
    "box container wrapper wrap block list item items section bar area link links button buttons btn slot unit panel form content text inner outer main top bottom "
    "left right side site page global primary secondary header post posts article articles story stories thread count icon icons row col column group grid card cards body".split()
)
STATES = {"no", "not", "has", "with", "without", "hide"}

# A quoted value ends at a quote that something proper follows; else the quote is stray and the tag ends at the next ">".
_TOKEN = re.compile(
    r"""<(?:(!--)|[!?][^>]*+>|/[^a-zA-Z>][^>]*+>|/>|(/?)([a-zA-Z][^\s/>]*+)"""
    r"""((?>[^>=]++|=\s*+"[^"]*+"(?=[\s/>]|[a-zA-Z-]+=)|=\s*+'[^']*+'(?=[\s/>]|[a-zA-Z-]+=)|=\s*+[^\s"'>][^\s>]*+|=)*+)>)"""
)
_COMMENT = re.compile(r"-?>|.*?--!?>", re.S)
_BROKEN = re.compile(r"<[a-zA-Z/!?]")
_EDGE = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*+>" if tag in UNNESTED else rf"<(/){tag}(?=[\s/>])[^>]*+>", re.I) for tag in SILENT}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"\shidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _is_frame(tag: str, attributes: str, inside_main: bool) -> bool:
    if tag in FRAME or tag == "header" and not inside_main:
        return True
    if not attributes or tag in ("html", "body") or tag in MAIN:
        return False
    return bool(_HIDDEN.search(attributes)) or _names_frame(attributes, inside_main, inside_main or tag in TEXTUAL)


def _names_frame(attributes: str, inside_main: bool, whole: bool = False) -> bool:
    """Whether class, id or role names a frame; ``whole``: by a name that says nothing else."""
    for found in _NAMED.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            parts = {part for part in _PARTS.split(name) if part and not part.isdigit()}
            if parts & STATES or whole and not parts <= FRAME_WORDS | CARRIERS:
                continue
            if parts & FRAME_WORDS or not inside_main and parts & HEADER_WORDS:
                return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """All lines of text of a page, whether an article or main element holds each, and whether its
    markup names it a part of the frame. Text of a frame within a line is a line of its own."""
    out: list[tuple[str, int]] = []
    plain = [0, 0, 0]  # unlinked characters outside articles, in them, and in those with a frame's name
    open_tags: list[tuple[str, bool, bool, bool]] = []
    frames = mains = named = links = choices = 0
    parts: list[str] = []
    side: list[str] = []
    linked = total = at = 0

    def close(n: int) -> None:
        nonlocal frames, mains, named, links, choices
        for tag, frame, main, card in open_tags[n:]:
            frames -= frame
            mains -= main
            named -= card
            links -= tag == "a"
            choices -= tag in CHOICES
        del open_tags[n:]

    def end_line() -> None:
        nonlocal linked, total
        if parts:
            line = " ".join("".join(parts).split())
            if line:
                kind = 2 if named else int(mains > 0)
                out.append((line, kind))
                plain[kind] += total - linked
            parts.clear()
        if side:
            line = " ".join("".join(side).split())
            if line:
                out.append((line, 3))
            side.clear()
        linked = total = 0

    def say(raw: str) -> None:
        nonlocal linked, total
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if frames:
            side.append(text)
        else:
            parts.append(text)
            total += len(text)
            linked += len(text) if links else 0

    end = page.rfind(">") + 1
    unclosed: set[str] = set()
    while found := _TOKEN.search(page, at, end):
        if found.start() > at:
            say(page[at : found.start()])
        at = found.end()
        if found[1]:
            closed = _COMMENT.match(page, at)
            at = closed.end() if closed else len(page)
            continue
        if not found[3]:
            continue
        tag = found[3].lower()
        if tag in SILENT:
            if not found[2] and tag not in unclosed and not (tag in ("svg", "math") and found[4].endswith("/")):
                edge = _EDGE[tag].search(page, at)
                if edge and edge[1]:
                    at = edge.end()
                elif tag in TO_THE_END:
                    at = len(page)
                elif not edge:
                    unclosed.add(tag)
            continue
        if tag == "br" or tag in ("td", "th"):
            (side if frames else parts).append(" ")
        if tag in VOID and tag != "hr":
            continue
        if choices and not found[2] and tag not in CHOICES:  # a list of choices ends where anything else begins
            end_line()
            close(next(i for i, entry in enumerate(open_tags) if entry[0] in CHOICES))
        if tag in BLOCKS:
            end_line()
        if found[2]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    close(i)
                    break
            continue
        if tag == "hr":
            continue
        if tag == "body":  # a head that was left open ends here
            close(next((i for i, entry in enumerate(open_tags) if entry[0] in ("head", "title")), len(open_tags)))
        if tag in BLOCKS:  # a paragraph ends where another block begins
            for i in range(len(open_tags) - 1, -1, -1):
                name = open_tags[i][0]
                if name == "p" or name == "li" == tag:
                    close(i)
                    break
                if name in BLOCKS:
                    break
        card = tag == "article" and _names_frame(found[4], True, True)
        entry = (tag, _is_frame(tag, found[4], mains > 0), tag in MAIN, card)
        open_tags.append(entry)
        frames += entry[1]
        mains += entry[2]
        named += card
        links += tag == "a"
        choices += tag in CHOICES
    rest = page[at:]
    broken = _BROKEN.search(rest)
    say(rest[: broken.start()] if broken else rest)
    end_line()
    cards = plain[2] > plain[0] + plain[1]  # articles with a frame's name hold most of the text
    if cards:
        plain[1] += plain[2]
    held = {1, 2} if cards else {1}
    body = plain[1] >= plain[0] and any(kind in held for _, kind in out)  # the articles are the body
    return [(line, kind in held, kind == 3 or kind == 2 and not cards or body and kind == 0) for line, kind in out]


#: Bits of the table of a longest common subsequence that are kept at once (8 MB); larger ones are halved.
TABLE_BITS = 1 << 26


def _lengths(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of ``a``: a number whose zero bits are the places of ``b`` where the longest common subsequence grows."""
    places: dict[int, int] = {}
    for j, value in enumerate(b):
        places[value] = places.get(value, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for value in a:
        met = row & places.get(value, 0)
        row = (row + met | row - met) & every
        yield row


def _growth(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``, the empty one first."""
    row = (1 << len(b)) - 1
    for row in _lengths(a, b):  # the last one counts
        pass
    bits = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64))])


def shared_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: rows of bits, halved while the table would be large (Hirschberg)."""
    at = np.nonzero(np.isin(a, b))[0]
    x, y = a[at].tolist(), b[np.isin(b, a)].tolist()
    out: list[int] = []
    left = [(0, len(x), 0, len(y))]
    while left:
        i, n, j, m = left.pop()
        while i < n and j < m and x[i] == y[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < n and j < m and x[n - 1] == y[m - 1]:
            n, m = n - 1, m - 1
            out.append(n)
        if i == n or j == m:
            continue
        if n - i > 1 and (n - i) * (m - j) > TABLE_BITS:
            half = (i + n) // 2
            cut = j + int(np.argmax(_growth(x[i:half], y[j:m]) + _growth(x[half:n][::-1], y[j:m][::-1])[::-1]))
            left += [(i, half, j, cut), (half, n, cut, m)]
            continue
        rows = [(1 << m - j) - 1, *_lengths(x[i:n], y[j:m])]
        k, col = n - i, m - j
        while k and col:
            if rows[k] >> col - 1 & 1:
                col -= 1
            elif not rows[k - 1] >> col - 1 & 1:
                k -= 1
            else:
                k, col = k - 1, col - 1
                out.append(i + k)
    return at[sorted(out)].tolist()


def _digest(page: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(page.encode("utf-8", "replace")), "little", signed=True)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, lines, kinds = [], [], []
        for page in batch.column(1).to_pylist():
            found = blocks(page)
            digests.append(_digest(page))
            lines.append([_digest(line) for line, *_ in found])
            kinds.append([FRAMED if frame else HELD if main else PLAIN for _, main, frame in found])
        columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(digests, pa.int64()), pa.array(lines, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int8()))]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "digest", "lines", "kinds"])


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _pair(group: pd.DataFrame) -> pd.DataFrame:
    """For each own page of a run: the places of the lines that it shares with its neighbour."""
    group = group.sort_values("place")
    rows = list(group[["host", "path", "lines", "kinds", "common", "own"]].itertuples(index=False))
    out = []
    for at, row in enumerate(rows):
        if not row.own or not len(row.lines):
            continue
        common = set() if row.common is None else set(row.common)
        body = sum(kind != FRAMED for kind in row.kinds)
        near = [i for i in range(max(at - NEAR, 0), min(at + NEAR + 1, len(rows))) if rows[i].host == row.host and not np.array_equal(rows[i].lines, row.lines)]
        gone: set[int] = set()
        for i in sorted(near, key=lambda i: (-_alike(rows[i].path, row.path), abs(i - at))):
            shared = shared_lines(np.asarray(row.lines), np.asarray(rows[i].lines))
            decides = sum(row.kinds[k] != FRAMED for k in shared) < COPY * max(body, 1)
            gone.update(k for k in shared if row.kinds[k] == FRAMED or decides and row.kinds[k] == PLAIN or row.lines[k] in common)
            if decides:
                break
        if gone:
            out.append((row.host, row.lines, row.kinds, sorted(gone)))
    return pd.DataFrame(out, columns=["host", "lines", "kinds", "gone"])


def common_lines(hashed: DataFrame) -> DataFrame:
    """(host, common): hashes of lines on at least COMMON of the different pages of a host."""
    different = hashed.select("host", "lines").distinct()
    hosts = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    lines = different.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    lines = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    found = lines.join(hosts, "host").where(F.col("n") >= COMMON * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list("line").alias("common"))


def frame_lines(pages: DataFrame) -> DataFrame:
    """(page_id, digest, gone): places of lines to leave out, for pages that have any."""
    spark = pages.sparkSession
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    address = F.regexp_replace(address, r"[?#].*$", "")
    host, path = F.lower(F.regexp_extract(address, r"^[^/]*", 0)), F.regexp_extract(address, r"/.*$", 0)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), path.alias("path"))
    hashed = rows.mapInArrow(_hash_rows, "page_id long, host string, path string, digest long, lines array<long>, kinds array<byte>")
    hashed, _ = materialise(hashed, "pages-lines")
    common, _ = materialise(common_lines(hashed), "pages-common", narrow=True)
    order = ["host", "path", "page_id", "digest"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    same = ["host", "lines", "kinds"]
    first = hashed.groupBy(*same).agg(F.min(F.struct("path", "page_id", "digest")).alias("first")).select(*same, "first.*")
    placed = first.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = placed.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed, _ = materialise(placed, "pages-ordered")
    starts, at = [], 0
    for part in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row per partition
        starts.append((part["part"], at))
        at += part["n"]
    if not starts:
        return spark.createDataFrame([], "page_id long, digest long, gone array<int>")
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    placed = placed.join(offsets, "part").withColumn("place", F.col("start") + F.col("row")).withColumn("run", F.expr(f"place div {RUN}"))
    edge = F.col("place") % RUN
    copies = F.array(F.lit(0), F.when(edge < NEAR, -1), F.when(edge >= RUN - NEAR, 1))
    placed = placed.select(*order, "lines", "kinds", "place", "run", F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("to"))
    placed = placed.withColumn("own", F.col("to") == 0).withColumn("run", F.col("run") + F.col("to"))
    placed = placed.join(F.broadcast(common) if common.count() <= BROADCAST_ROWS else common.hint("merge"), "host", "left")
    gone = placed.groupBy("run").applyInPandas(_pair, "host string, lines array<long>, kinds array<byte>, gone array<int>")
    return hashed.join(gone, same).select("page_id", "digest", "gone")


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            out = set(gone or ())
            texts.append("\n".join(line for i, (line, _, frame) in enumerate(blocks(page)) if not frame and i not in out))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = pa.array([_digest(page) for page in batch.column("html").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("html"), digests], ["page_id", "url", "html", "digest"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)
    gone, _ = materialise(frame_lines(pages), "pages-frames")
    gone = gone.dropDuplicates(["page_id", "digest"])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    n = gone.count()
    if n:
        rows = rows.mapInArrow(_digest_rows, "page_id long, url string, html string, digest long")
        rows = rows.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone.hint("merge"), ["page_id", "digest"], "left")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("array<int>"))
    return rows.select("page_id", "url", "html", "gone").mapInArrow(_text_rows, "page_id long, url string, text string, n_chars long")
