"""HTML extraction by nearest-URL page differencing over structured text lines.

A page is cut into text lines: its blocks, in page order, menus, adverts and footers included;
outside an article a block is cut further at the separators that site furniture uses.
Pages of a host are ordered by URL path and each is paired with the nearest page of other
content that shares the longest path prefix; the two pages' lines are aligned by longest common
subsequence and the shared lines deleted, for what two pages of a site have in common is the site's.

Every page goes through that, and differencing acts first. Markup says two things more. Lines in an
``article`` or ``main`` element are protected: passages and whole articles recur from page to page, so
they are evidence about other pages but stay. And of the lines that differ from the nearest
page's, those in elements that are never the article (menus, adverts, forms, ...; by tag, role, or a
class or id all of whose words say so) go too: a menu that changes with every page is still none.

Pages of equal content (mirrors, whatever their menus) stand for one: the ordered pages are collapsed to runs
of equal content, so that the runs next to a page's own are its nearest different pages, however
many mirrors stand side by side. Only line hashes travel; runs are dealt out in blocks of
``BLOCK`` neighbours (with one run of overlap), however many pages a host has, and all joins are by
hashed keys, which the adaptive skew join can split.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import checkpoint

BLOCK = 512

_PLAIN_TAG = re.compile(r"<(/?)([a-z][^\s/>]*)([^>\"']*)>", re.I)
_TAG = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
#: What ends a tag, or opens a quoted value: a quote counts only behind an equals sign.
_STOP = re.compile(r">|=\s*([\"'])")
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style textarea title noscript template iframe xmp".split()}
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img".split()
)
_SKIP = frozenset("head nav footer aside form button select option svg canvas object menu dialog datalist audio video map".split())
_SKIP_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments "
    "cookie cookies consent newsletter subscribe related share sharing pagination login search notice notices respond disqus".split()
)
#: Words that change nothing about a class of the above.
_NEUTRAL = frozenset("area bar block bottom box container content form inner left links list main page posts reader readers right section site slot social thread top user wrap wrapper".split())
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MAIN = frozenset(("article", "main"))
_SEPARATOR = re.compile(r"(?<=\s)(?=[·|»›•]\s)")


def tokens(page: str) -> Iterator[tuple[int, int, str | None, str, bool]]:
    """(start, end, tag, attributes, closing) of all markup, in one pass whose time is linear in the page, however broken.

    Comments, declarations and the contents of scripts and the like come as one token without a tag. A value whose
    quote is never closed ends at a space; where no tag can be closed for quotes, they do not count from there on. A ``<`` that opens nothing is text.
    """
    at, closed, quotes = 0, page.rfind(">"), True
    last = {q: page.rfind(q) for q in "\"'"}
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, None, "", False
            continue
        if start > closed:
            continue
        if m := _PLAIN_TAG.match(page, start):
            end = m.end()
        elif m := _TAG.match(page, start):
            end, here = -1, m.end()
            while quotes and (stop := _STOP.search(page, here)):
                here = stop.end()
                if stop[1] is None:
                    end = here
                    break
                if last[stop[1]] >= here:
                    here = page.index(stop[1], here) + 1
            if end < 0:
                quotes, end = False, page.index(">", m.end()) + 1
        elif page[at : at + 1] in ("!", "?", "/"):
            at = page.index(">", at) + 1
            yield start, at, None, "", False
            continue
        else:
            continue
        tag, at = m[2].lower(), end
        if not m[1] and tag in _RAW:
            over = _RAW[tag].search(page, end)
            at = over.end() if over else len(page)
            yield start, at, None, "", False
        else:
            yield start, at, tag, page[m.end(2) : end - 1], bool(m[1])


def _skipped(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in _SKIP or tag == "header" and not in_main:
        return True
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in _SKIP_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for name in value.split():
                parts = set(re.split(r"[_-]+", name)) - _NEUTRAL
                if parts and parts <= _SKIP_NAMES:
                    return True
    return False


def lines_of(page: str | None) -> tuple[list[str], list[bool], list[bool]]:
    """Text lines; whether each stands in an article or main; whether in an element that is never the article."""
    page = page or ""
    lines: list[str] = []
    inside: list[bool] = []
    marked: list[bool] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, skipped, main
    open_tags: dict[str, int] = {}
    skipping = mains = 0
    piece: list[str] = []
    done = 0

    def flush() -> None:
        if piece:
            line = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            for part in (line,) if mains else _SEPARATOR.split(line):
                if part := part.strip():
                    lines.append(part)
                    inside.append(mains > 0)
                    marked.append(skipping > 0)

    def pop() -> str:
        nonlocal skipping, mains
        flush()
        tag, skip, main = stack.pop()
        open_tags[tag] -= 1
        skipping -= skip
        mains -= main
        return tag

    for start, end, tag, attrs, closing in tokens(page):
        if start > done:
            piece.append(page[done:start])
        done = end
        if tag is None:
            continue
        if tag in _INLINE and not (attrs and not closing and _skipped(tag, attrs, mains > 0)) and not open_tags.get(f"!{tag}"):
            continue
        if closing:
            name = f"!{tag}" if tag in _INLINE else tag
            if open_tags.get(name):
                while pop() != name:
                    pass
            else:
                flush()
            continue
        flush()
        if tag in _VOID:
            continue
        if tag in ("p", "li", "tr", "td", "th", "dd", "dt", "option") and stack and stack[-1][0] == tag:
            pop()
        if tag == "body" and open_tags.get("head"):
            while pop() != "head":
                pass
        skip, main = _skipped(tag, attrs, mains > 0), tag in _MAIN
        name = f"!{tag}" if tag in _INLINE else tag
        stack.append((name, skip, main))
        open_tags[name] = open_tags.get(name, 0) + 1
        skipping += skip
        mains += main
    piece.append(page[done:])
    flush()
    return lines, inside, marked


def split_url(url: str | None) -> tuple[str | None, str]:
    """(host, path) without scheme, query and fragment; the host in lower case."""
    if url is None:
        return None, ""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url)
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of a in a longest common subsequence with b.

    Equal ends are cut off, then Hirschberg's divide-and-conquer runs on bit-parallel rows.
    """
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.add(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.add(j)
        common = set(a[i:j]) & set(b[k:m])
        if not common:
            continue
        if j - i == 1:
            out.add(i)
            continue
        mid = (i + j) // 2
        left = _row(a[i:mid], b[k:m])
        right = _row(a[mid:j][::-1], b[k:m][::-1])
        n = m - k
        cut = max(range(n + 1), key=lambda c: left[c] + right[n - c])
        todo += [(i, mid, k, k + cut), (mid, j, k + cut, m)]
    return out


def _row(a: list[int], b: list[int]) -> list[int]:
    """Longest common subsequence of a with each prefix of b."""
    n = len(b)
    where: dict[int, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << n) - 1
    v = full
    for x in a:
        hit = v & where.get(x, 0)
        v = ((v + hit) | (v - hit)) & full
    bits = np.unpackbits(np.frombuffer((~v & full).to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n]
    return [0, *np.cumsum(bits, dtype=np.int64).tolist()]


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, hashes, content = [], [], [], []
        for url, page in zip(batch.column(2), batch.column(3), strict=True):
            host, path = split_url(url.as_py())
            lines, _, marked = lines_of(page.as_py())
            own = [x for x, no in zip(lines, marked, strict=True) if not no]
            hosts.append(host)
            paths.append(path)
            hashes.append([_hash(x) for x in lines])
            content.append(xxhash.xxh64_intdigest("\n".join(own).encode("utf-8", "surrogatepass")) - (1 << 63) if own else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(content, pa.int64()),
                pa.array(hashes, pa.list_(pa.int64())),
            ],
            ["page_id", "sig", "host", "path", "content", "lines"],
        )


_OUTLINE = "page_id long, sig long, host string, path string, content long, lines array<long>"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number, in its sorted partition, of each page's run of one host and equal content."""
    nth, last = -1, None
    for batch in batches:
        out = []
        for key in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            nth, last = nth + (key != last), key
            out.append(nth)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "nth"])


def takes_before(path: str, before: str | None, after: str | None) -> bool:
    """Whether the page before shares at least as long a path prefix as the one after."""
    if before is None or after is None:
        return after is None
    return len(commonprefix([before, path])) >= len(commonprefix([after, path]))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        path, before, after = (batch.column(k).to_pylist() for k in (2, 4, 5))
        move = [-1 if takes_before(*x) else 1 for x in zip(path, before, after, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.compute.add(batch.column(3), pa.array(move, pa.int64()))], ["page_id", "sig", "run"])


def _runs(pages: DataFrame) -> DataFrame:
    """The pages' outlines with the number of their run of equal content, in the order of host and path."""
    slim = pages.select("page_id", "sig", "url", "html").mapInArrow(_outline, _OUTLINE).where("host IS NOT NULL AND content IS NOT NULL")
    order = ["host", "path", "page_id", "sig"]
    slim = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    slim = checkpoint(slim.mapInArrow(_numbered, f"{_OUTLINE}, nth long")).withColumn("part", F.spark_partition_id())
    key = F.struct("host", "content")
    ends = slim.groupBy("part").agg((F.max("nth") + 1).alias("n"), F.min_by(key, "nth").alias("first"), F.max_by(key, "nth").alias("last"))
    parts = Window.orderBy("part")  # one row per partition
    ends = ends.withColumn("goes_on", F.col("first").eqNullSafe(F.lag("last").over(parts)).cast("long"))
    ahead = F.coalesce(F.sum(F.col("n") - F.col("goes_on")).over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(ends.select("part", (ahead - F.col("goes_on")).alias("ahead")))
    return slim.join(starts, "part").withColumn("run", F.col("ahead") + F.col("nth"))


def nearest_lines(pages: DataFrame) -> DataFrame:
    """(page_id, sig, other): the line hashes of each page's nearest different page, where it has one."""
    ranked = _runs(pages)
    first = F.struct("path", "page_id", "sig")  # the page whose lines stand for the run
    runs = ranked.groupBy("run").agg(F.min_by("host", first).alias("host"), F.min("path").alias("low"), F.max("path").alias("high"))
    own = F.floor(F.col("run") / BLOCK)
    edge = F.when(F.col("run") % BLOCK == 0, own - 1).when(F.col("run") % BLOCK == BLOCK - 1, own + 1)
    dealt = runs.select("*", F.explode(F.array_compact(F.array(own, edge))).alias("block"))
    block = Window.partitionBy("block").orderBy("run")
    beside = lambda move, what: F.when(move("host").over(block) == F.col("host"), move(what).over(block))
    sides = dealt.select("run", "block", beside(F.lag, "high").alias("before"), beside(F.lead, "low").alias("after"))
    sides = sides.where((F.col("block") == own) & (F.col("before").isNotNull() | F.col("after").isNotNull())).drop("block")
    slim = ranked.select("page_id", "sig", "path", "run").distinct()
    chosen = slim.join(sides, "run").select("page_id", "sig", "path", "run", "before", "after").mapInArrow(_nearest, "page_id long, sig long, run long")
    lines = ranked.groupBy("run").agg(F.min_by("lines", first).alias("other"))
    return chosen.join(lines, "run").drop("run")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for page, other in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            lines, inside, marked = lines_of(page.as_py())
            gone = {k for k in shared_lines([_hash(x) for x in lines], other) if not inside[k]} if other else ()
            texts.append(" ".join(x for k, x in enumerate(lines) if k not in gone and not marked[k]))
            counts.append((len(texts[-1]), len(lines), len(gone), sum(no and k not in gone for k, no in enumerate(marked))))
        numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *numbers], ["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_marked"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages(page_id, url, html)``.

    And of its n_lines, the n_shared that differencing deleted and the n_marked that only markup did.
    Null or empty html gives an empty text. A null url has no host and so no neighbour, and a page
    without content is none. Repeated rows stay and are equal; ties in the path go by page_id. Broken
    markup (unclosed or stray tags) never raises. No rows give no rows; other columns are ignored.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.xxhash64("url", "html").alias("sig"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    near = nearest_lines(own).withColumnsRenamed({"page_id": "at_id", "sig": "at_sig"})
    joined = own.join(near, own.page_id.eqNullSafe(near.at_id) & (own.sig == near.at_sig), "left")
    return joined.select("page_id", "url", "html", "other").mapInArrow(_texts, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_marked long")
