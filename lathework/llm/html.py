"""Main text of web pages: markup rules, and a suffix array over each host's token streams.

A page is cut into text blocks in page order. Markup settles most of them: text
inside the article is main text; scripts, styles, menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are not. Blocks that markup
leaves open (all of a page without an article and without marks) form the page's
token stream, and the suffix array over the streams of a host settles them: token
runs that recur on distinct pages are boilerplate and are removed, what is unique
stays in its place.

The array of a host is never gathered. A run of ``MIN_RUN`` tokens is enough, as
a longer one is covered by its parts, so suffixes are sorted to that depth: the
array is then a row of buckets, and a bucket's pages are counted. Each task sorts
the suffixes of its own pages, host by host, and gives out a row for each bucket;
the sums over tasks are those of the whole host's array, whatever its size and
however its pages are dealt. A run is boilerplate if ``MIN_PAGES`` pages of the
host have it; pages with equal streams count as one, so copied pages stay whole. Article text takes no part: articles may quote or copy
each other and nothing of them may go.
"""

from __future__ import annotations

import collections
import html as html_entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm.common import bounded_broadcast, map_texts
from lathework.session import materialize

#: Tokens that a recurring run has at least, and different pages of the host that it is on at least, however large the host.
MIN_RUN, MIN_PAGES = 6, 3
#: Rows of 8 to 16 bytes that are sent to every task at most.
MAX_SENT = 1_000_000

DROP = {"script", "style", "noscript", "template", "svg", "math", "canvas", "iframe", "object", "head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "video", "audio", "map"}
RAW = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Words of a class, id or role that mark what is not main text, if all its other words are only of the page's layout.
CHROME = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "footer", "sidebar", "aside", "complementary", "contentinfo", "widget", "related", "recommended", "share", "sharing",
    "social", "subscribe", "subscription", "newsletter", "signup", "login", "search", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies",
}
LAYOUT = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "center", "col", "column", "container", "element", "fixed", "form", "global", "group", "inner", "item", "items", "large", "left", "link", "links", "list", "main", "outer", "page",
    "panel", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "small", "stories", "sticky", "text", "top", "unit", "user", "users", "reader", "readers", "wrap", "wrapper", "zone",
}
NAME = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
EDGE = re.compile(r"[>\"']")
MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
SPACE = re.compile(r"\s+")
#: Elements that frame the page: only their own end tags, and those of elements around them, close them.
FRAME, MAX_FRAMES = {"article", "main", "body", "html"}, 16
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN, OTHER, CHROMED = 1, 0, -1


def _chrome(tag: str, attributes: str) -> bool:
    if tag in DROP:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    for m in MARK.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        if any(_marks(name) for name in value.split()):
            return True
    return False


def _marks(name: str) -> bool:
    """Whether a class, id or role names what is not main text: ``ad``, ``site-nav``, ``adSlot3``, but not ``ad-free`` or ``share-price``."""
    words = {w for w in SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()}
    return not words.isdisjoint(CHROME) and words <= CHROME | LAYOUT


def _tag_end(source: str, at: int, loose: bool) -> tuple[int, bool]:
    """Where the ``>`` of a tag is whose name ends at ``at``, -1 if there is none, and whether quotes still count.

    A ``>`` inside quotes does not end a tag. If that leaves a tag without an end, quotes
    are not balanced: from there on the first ``>`` ends a tag. A page is scanned twice at most.
    """
    if not loose:
        k = at
        while (m := EDGE.search(source, k)) is not None:
            if m[0] == ">":
                return m.start(), False
            k = source.find(m[0], m.end()) + 1
            if k == 0:
                break
    return source.find(">", at), True


def text_blocks(source: str | None) -> list[tuple[int, str]]:
    """``(kind, text)`` of each non-empty block in page order: MAIN, OTHER or CHROMED (settled by markup).

    If the page has an article or main element, only text inside it is MAIN and
    the rest that is not CHROMED is OTHER; a page without one has no MAIN text.
    """
    source = source or ""
    out: list[tuple[int, str]] = []
    # tag, chrome from here on, main from here on, chrome for another reason than a header in the article, frames up to here
    stack: list[tuple[str, bool, bool, bool, int]] = []
    opened: collections.Counter = collections.Counter()  # open tags by frame and name
    buffer: list[str] = []
    kind = OTHER
    at, n = 0, len(source)
    loose = False

    def flush() -> None:
        if buffer:
            text = SPACE.sub(" ", html_entities.unescape("".join(buffer))).strip()
            if text:
                out.append((kind, text))
            buffer.clear()

    def pop() -> str:
        tag, *_, frames = stack.pop()
        opened[frames, tag] -= 1
        return tag

    while at < n:
        m = NAME.search(source, at)
        if m is None:
            buffer.append(source[at:])
            break
        buffer.append(source[at : m.start()])
        if m[1]:
            end = source.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m[2]:
            end = source.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        end, loose = _tag_end(source, m.end(), loose)
        if end < 0:
            break  # a tag that was cut off
        at = end + 1
        tag, attributes = m[4].lower(), source[m.end() : end]
        if tag in BLOCK or tag in DROP:
            flush()
        frames = stack[-1][4] if stack else 0
        if m[3]:
            if tag in FRAME:
                if any(opened[k, tag] > 0 for k in range(1, frames + 1)):
                    while pop() != tag:
                        pass
            elif opened[frames, tag] > 0:  # a stray end tag does not close the page's frame
                while pop() != tag:
                    pass
        elif tag not in VOID and not attributes.endswith("/"):
            if tag == "p" and stack and stack[-1][0] == "p":
                pop()
            up, chrome, main, hard, _ = stack[-1] if stack else ("", False, False, False, 0)
            own = _chrome(tag, attributes)
            if main and tag in HEADING and up == "header":
                chrome = hard or own  # the article's own title
            else:
                chrome = chrome or own or tag == "header"
            hard = hard or (own and tag != "header")
            # frames in frames share a number beyond a few, so that closing one stays cheap
            frames = min(frames + 1, MAX_FRAMES) if tag in FRAME else frames
            stack.append((tag, chrome, main or (not chrome and tag in ("article", "main")), hard, frames))
            opened[frames, tag] += 1
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = close.end() if close else n
                pop()
        _, chrome, main, _, _ = stack[-1] if stack else ("", False, False, False, 0)
        new = CHROMED if chrome else MAIN if main else OTHER
        if new != kind:
            flush()
            kind = new
    flush()
    return out


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of an integer sequence sorted by their first ``depth`` tokens or more, and their ranks: equal prefixes, equal ranks.

    By doubling the compared length.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < depth:
        add = min(step, depth - step)  # never beyond the depth
        second = np.zeros(n, np.int64)
        second[: n - add] = rank[add:] + 1
        order = np.lexsort((second, rank))
        new = np.empty(n, np.int64)
        change = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        new[order] = np.concatenate([[0], np.cumsum(change)])[:n]
        rank = new
        step += add
    return order, rank


def run_hash(host: str, tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest("\0".join([host, *tokens]).encode("utf-8", "replace")) - (1 << 63)


def buckets(streams: list[list[str]], min_run: int = MIN_RUN) -> list[tuple[int, int, int]]:
    """The suffix array's buckets of ``min_run`` tokens: a page and position where each occurs, and how many of the pages have it."""
    number: dict[str, int] = {}
    words, page = [], []
    for k, s in enumerate(streams):
        words += [number.setdefault(t, len(number)) for t in s]
        words.append(-1 - k)  # ends are distinct: no run crosses pages
        page += [k] * (len(s) + 1)
    if len(words) == len(streams):
        return []
    tokens, page = np.array(words, np.int64), np.array(page)
    ends = np.flatnonzero(tokens < 0)
    order, rank = suffix_array(tokens, min_run)
    whole = ends[page] - np.arange(len(tokens)) >= min_run  # the run ends before the page does
    order = order[whole[order]]
    if not len(order):
        return []
    pairs = np.unique(rank[order] * len(streams) + page[order])
    spread = np.bincount(pairs // len(streams), minlength=rank.max() + 1)
    first = order[np.concatenate([[True], rank[order][1:] != rank[order][:-1]])]
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [(int(page[p]), int(p - starts[page[p]]), int(spread[rank[p]])) for p in first]


def open_tokens(kinds: list[int], texts: list[str]) -> list[str]:
    return [w for k, t in zip(kinds, texts, strict=True) if k == OTHER for w in t.split(" ")]


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _merge(host: str, kinds: list[int], texts: list[str], runs: set[int], min_run: int) -> str:
    """Main blocks, and of open blocks what no recurring run covers, in page order."""
    stream = open_tokens(kinds, texts) if runs else []
    hit = bytearray(len(stream))
    for k in range(len(stream) - min_run + 1):
        if run_hash(host, stream[k : k + min_run]) in runs:
            hit[k : k + min_run] = b"\1" * min_run
    out, at = [], 0
    for kind, text in zip(kinds, texts, strict=True):
        if kind == OTHER and runs:
            words = text.split(" ")
            text = " ".join(w for w, h in zip(words, hit[at : at + len(words)], strict=True) if not h)
            at += len(words)
        if kind != CHROMED and text:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(id, url, text)`` for every row of ``pages``; the text is empty where there is none.

    Null pages count as empty; pages without a host form one host. Rows repeat as
    in ``pages``; equal ones count once for runs. Other columns are ignored.
    """

    def cut() -> Callable:
        def of(sources: list) -> list[list]:
            found = [text_blocks(s) for s in sources]
            kinds, texts = [[k for k, _ in f] for f in found], [[t for _, t in f] for f in found]
            streams = [open_tokens(k, t) for k, t in zip(kinds, texts, strict=True)]
            return [kinds, texts, [len(s) for s in streams], [xxhash.xxh64_intdigest(" ".join(s).encode("utf-8", "replace")) - (1 << 63) for s in streams]]

        return of

    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host_of(url_col).alias("host"))
    own = map_texts(own, ["_id", "_url", "host"], "_html", cut, [("kinds", "array<int>"), ("texts", "array<string>"), ("n_open", "int"), ("stream", "long")], rows=128)
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "blocks")
    undecided = own.where("n_open > 0")

    # pages with equal streams count once
    reps = materialize(undecided.groupBy("host", "stream").agg(F.min("row").alias("first"), F.count("*").alias("c")), "streams")
    spare, _ = bounded_broadcast(undecided.select("host", "stream", "row").join(reps.where("c > 1"), ["host", "stream"]).where("row <> first").select("row"), MAX_SENT)

    def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                by: dict[str, list[list[str]]] = collections.defaultdict(list)
                for host, kinds, texts in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    by[host].append(open_tokens(kinds, texts))
                found = [(run_hash(host, streams[p][k : k + min_run]), n) for host, streams in by.items() for p, k, n in buckets(streams, min_run)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["run", "n"])

    runs = undecided.join(spare, "row", "left_anti").select("host", "kinds", "texts").mapInArrow(count_runs, "run long, n long")
    runs = runs.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages)
    runs, _ = bounded_broadcast(materialize(runs.select("run"), "runs"), MAX_SENT)

    def runs_of() -> Callable:
        def of(rows: list) -> list[list]:
            out = []
            for r in rows:
                s = open_tokens(r["kinds"], r["texts"])
                out.append(list({run_hash(r["host"], s[k : k + min_run]) for k in range(len(s) - min_run + 1)}))
            return [out]

        return of

    held = map_texts(undecided.select("row", F.struct("host", "kinds", "texts").alias("_page")), ["row"], "_page", runs_of, [("runs", "array<long>")], rows=256)
    held = held.select("row", F.explode("runs").alias("run")).join(runs, "run").groupBy("row").agg(F.collect_list("run").alias("runs"))
    none = F.array().cast("array<long>")
    settled = own.where("n_open = 0").withColumn("runs", none)
    undecided = undecided.join(materialize(held, "covered"), "row", "left").withColumn("runs", F.coalesce("runs", none))

    def merge() -> Callable:
        return lambda rows: [[_merge(r["host"], r["kinds"], r["texts"], set(r["runs"]), min_run) for r in rows]]

    page = F.struct("host", "kinds", "texts", "runs").alias("_page")
    done = settled.select("_id", "_url", page).unionByName(undecided.select("_id", "_url", page))
    return map_texts(done, ["_id", "_url"], "_page", merge, [("text", "string")], rows=256).withColumnsRenamed({"_id": id_col, "_url": url_col})


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
