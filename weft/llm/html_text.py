"""Main text of web pages, with a suffix array over the token streams of each host.

Markup is read in one pass into blocks; containers that say what they are (navigation, footers, forms, adverts, reader
comments and so on) are left out, and where the page marks its article only that is kept.  What a page's template
repeats is found without markup: token streams of pages are concatenated and their suffixes sorted by their first eight
tokens; a run met outside the marked articles of several pages of a host is boilerplate wherever it stands on that host.
Pages are sorted a shard at a time; a run is named by a hash of its host and words, and its pages are summed over all shards.
Unmarked text loses covered tokens and keeps its unique runs.  A marked article is kept whole: passages that articles
share with each other, or with an advert, are part of it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import small_batches
from weft.plans.runtime import materialize

RUN = 8
LEAST_PAGES = 3
PAGES_PER_SHARD = 1024
FREQUENT = 500_000

# Elements of HTML by what they do to text.
RAW = "script style textarea title xmp iframe noembed noframes template svg math noscript".split()
BLOCK = (
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul"
).split()
CONTAINER = (
    "article aside body button details dialog div dl fieldset figure footer form head header hgroup html main menu nav ol "
    "section select span table ul"
).split()
DROPPED = "aside button dialog footer form head menu nav select".split()
MARKED = "article main".split()
DROPPED_ROLES = "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
DROPPED_NAMES = (
    "ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs byline-share comment comments consent "
    "cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification popup promo promoted promotion related replies reply respond responses share sharing sidebar signup skip-link "
    "social sponsor sponsored subscribe subscription toolbar widget"
).split()
HEADING = "header masthead banner".split()  # inside an article these head the article
ABSENT = "has hide is no not with without".split()  # as the first part of a class they speak of the page's layout
OF_ARTICLE = "article content entry post story".split()  # before a heading's name: the heading of the article
HOLDERS = (  # as the last part, after a dropped name: something that holds what is dropped
    "area articles bar block box button buttons container content footer form group header icons inner item items link links "
    "list panel popup posts section slot stories text thread title toggle unit widget wrap wrapper"
).split()

_DROPPED, _MARKED, _ROLES, _NAMES = set(DROPPED), set(MARKED), set(DROPPED_ROLES), set(DROPPED_NAMES)
_HEADING, _ABSENT, _OF_ARTICLE, _HOLDERS = set(HEADING), set(ABSENT), set(OF_ARTICLE), set(HOLDERS)
_RAW, _BLOCK, _CONTAINER = set(RAW), set(BLOCK), set(CONTAINER)
# possessive throughout, and no tag goes past the next "<" outside quotes, so that unclosed tags cost no more than closed ones
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Block:
    text: str
    marked: bool
    dropped: bool


def _says(word: str, marked: bool) -> bool:
    """Whether a class or id says that what it names is no part of the article; ``marked``: it stands inside the article.

    One of the names, or parts joined by - or _ that end in one (site-footer) or begin with one and end in a holder
    (comment-list).  Not: layout (no-sidebar), the heading of an article (entry-header), other compounds (social-science).
    """
    if word in _NAMES:
        return not (marked and word in _HEADING)
    parts = [x for x in re.split(r"[-_]+", word) if x]
    if len(parts) < 2 or parts[0] in _ABSENT:
        return False
    if parts[-1] in _HEADING and (marked or parts[0] in _OF_ARTICLE):
        return False
    return parts[-1] in _NAMES or (parts[0] in _NAMES and parts[-1] in _HOLDERS)


def _nature(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether a container marks the article, and whether it is to be left out.  Classes of the page's outermost elements and of
    the article itself tell of their layout or subject, so they do not count."""
    marked, dropped = name in _MARKED, name in _DROPPED
    if attributes.strip(" /"):
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), entities.unescape(value.strip("\"'")).lower()
            if key in ("class", "id"):
                if not marked and name not in ("html", "body"):
                    dropped |= any(_says(w, inside) for w in value.split())
            elif key == "role":
                marked, dropped = marked or value == "main", dropped or value in _ROLES
            elif key == "itemprop":
                marked |= value == "articlebody"
                dropped |= value == "comment"
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
                dropped = True
    return marked, dropped


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order: references decoded, white space made single, empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, marked and dropped so far down
    is_open: dict[str, int] = {}  # how often each name is on the stack
    marked = dropped = False
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, marked, dropped))
            parts.clear()

    while m := _TAG.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            flush()
        if name in _RAW and not m[1]:
            flush()
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
        elif name in _CONTAINER:
            if m[1]:
                if is_open.get(name):
                    flush()
                    closed = None
                    while closed != name:
                        closed = stack.pop()[0]
                        is_open[closed] -= 1
                    marked, dropped = stack[-1][1:] if stack else (False, False)
            else:
                own = _nature(name, m[3], marked)
                if own != (False, False):
                    flush()
                # a header inside the article heads the article; elsewhere it heads the page
                leave = own[1] or (name in ("header", "hgroup") and not (marked or own[0]))
                marked, dropped = marked or own[0], dropped or leave
                stack.append((name, marked, dropped))
                is_open[name] = is_open.get(name, 0) + 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def repeated(stream: np.ndarray, page: np.ndarray, outside: np.ndarray, run: int = RUN, least_pages: int = LEAST_PAGES) -> np.ndarray:
    """Positions of ``stream`` covered by a run of ``run`` tokens that stands, wholly outside articles, on ``least_pages`` pages.

    ``page`` gives each token's page; runs never cross from page to page.  The suffixes are ranked by their first
    1, 2, 4, ... tokens (prefix doubling), which leaves suffixes that agree in ``run`` tokens side by side.
    """
    starts, rank = _ranked(stream, page, run)
    if not len(starts):
        return np.zeros(len(stream), bool)
    kinds, pages, _ = _outside(starts, rank, page, outside, run)
    return _cover(len(stream), starts[np.isin(rank, kinds[pages >= least_pages])], run)


def _ranked(stream: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that start a run within their page, and the ranks of these runs: equal for equal runs."""
    n = len(stream)
    if n < run:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank, width = stream.astype(np.int64), 1
    last = np.searchsorted(page, page, side="right")  # end of the page of each token
    while width < run:
        step = min(width, run - width)
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        short = np.flatnonzero(np.arange(n) + width + step > last)  # fewer tokens are left in the page: like no other
        second[short] = -1 - short
        rank = _pairs(rank, second)
        width += step
    starts = np.flatnonzero(np.arange(n) + run <= last)
    return starts, rank[starts]


def _outside(starts: np.ndarray, rank: np.ndarray, page: np.ndarray, outside: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the runs that stand wholly outside articles, on how many pages each does, and a position of each."""
    inside = np.concatenate(([0], np.cumsum(~outside)))
    free = inside[starts + run] == inside[starts]
    kinds, first, which = np.unique(rank[free], return_index=True, return_inverse=True)
    width = int(page[-1]) + 1 if len(page) else 1
    pages = np.bincount(np.unique(which * width + page[starts[free]]) // width, minlength=len(kinds))
    return kinds, pages, starts[free][first]


def _cover(n: int, hits: np.ndarray, run: int) -> np.ndarray:
    """Which of n positions lie in a run that starts at one of ``hits``."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, hits, 1)
    np.add.at(mark, hits + run, -1)
    return np.cumsum(mark)[:n] > 0


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs in their order."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    rank = np.empty(len(first), np.int64)
    rank[order] = new
    return rank


Words = dict[tuple[str, str], int]


def streams(pages: list[list[Block]], hosts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Token numbers of all pages, the page of each token, whether it is outside articles, and the words: those of each host are its own."""
    number: Words = {}
    tokens, page, outside = [], [], []
    for p, (own, host) in enumerate(zip(pages, hosts, strict=True)):
        for block in own:
            words = block.text.split(" ")
            tokens += [number.setdefault((host, w), len(number)) for w in words]
            page += [p] * len(words)
            outside += [not block.marked] * len(words)
    return np.array(tokens, np.int64), np.array(page, np.int64), np.array(outside, bool), number


def names(stream: np.ndarray, at: np.ndarray, number: Words, run: int) -> np.ndarray:
    """Names of the runs that start at ``at``, 128 bits in two columns: the same in every shard for the same host and words."""
    digests = b"".join(blake2b(f"{h}\0{w}".encode("utf-8", "surrogatepass"), digest_size=16).digest() for h, w in number)
    each = np.frombuffer(digests, "<u8").reshape(-1, 2)
    out = np.zeros((len(at), 2), np.uint64)
    for k in range(run):
        out = out * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64) + each[stream[at + k]]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def known(found: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which rows of ``found`` are among ``listed``, whose rows are sorted by their first column."""
    out = np.zeros(len(found), bool)
    low = np.searchsorted(listed[:, 0], found[:, 0], side="left")
    high = np.searchsorted(listed[:, 0], found[:, 0], side="right")
    for k in range(int((high - low).max(initial=0))):
        at = np.minimum(low + k, len(listed) - 1)
        out |= (low + k < high) & (listed[at, 1] == found[:, 1])
    return out


def shard_runs(pages: list[list[Block]], hosts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Names of the runs that stand outside articles in a shard, and on how many of its pages each does."""
    stream, page, outside, number = streams(pages, hosts)
    starts, rank = _ranked(stream, page, run)
    _, counts, at = _outside(starts, rank, page, outside, run)
    return names(stream, at, number, run), counts


def main_texts(pages: list[list[Block]], run: int = RUN, least_pages: int = LEAST_PAGES) -> list[tuple[str, int]]:
    """Main text of each page of a host, and how many of its tokens the host's boilerplate covers."""
    stream, page, outside, _ = streams(pages, [""] * len(pages))
    return _texts(pages, repeated(stream, page, outside, run, least_pages))


def shard_texts(pages: list[list[Block]], hosts: list[str], listed: list[np.ndarray], run: int = RUN) -> list[tuple[str, int]]:
    """As :func:`main_texts` for a shard of pages, where the boilerplate is the runs whose names one of ``listed`` has."""
    stream, page, _, number = streams(pages, hosts)
    starts, rank = _ranked(stream, page, run)
    _, first, which = np.unique(rank, return_index=True, return_inverse=True)
    found = names(stream, starts[first], number, run)
    hit = np.zeros(len(found), bool)
    for some in listed:
        hit |= known(found, some)
    return _texts(pages, _cover(len(stream), starts[hit[which]], run))


def _texts(pages: list[list[Block]], covered: np.ndarray) -> list[tuple[str, int]]:
    out, at = [], 0
    for own in pages:
        has_main, kept, gone = any(b.marked and not b.dropped for b in own), [], 0
        for block in own:
            words = block.text.split(" ")
            hit = covered[at : at + len(words)]
            at += len(words)
            gone += int(hit.sum())
            if block.dropped or (has_main and not block.marked):
                continue
            if block.marked:
                kept.append(block.text)
            else:
                kept += [w for w, h in zip(words, hit, strict=True) if not h]
        out.append((" ".join(kept), gone))
    return out


def _sorted(table: pa.Table) -> np.ndarray:
    both = np.stack([table["a"].to_numpy(), table["b"].to_numpy()], axis=1).astype(np.int64).reshape(-1, 2)
    return both[np.argsort(both[:, 0], kind="stable")]


def extract(pages: DataFrame, pages_per_shard: int = PAGES_PER_SHARD, frequent: int = FREQUENT) -> DataFrame:
    """``page_id url text n_chars n_repeated`` for every row of ``pages(page_id, url, html)``.

    Null html counts as empty and gives an empty text; a null url is a host of its own.  Repeated rows are kept, each
    with its text.  Pages are read twice, each time where they lie and at most ``pages_per_shard`` of them to a suffix
    array: first every shard tells its runs outside articles with the number of their pages, which are summed over the whole
    host; then the runs on enough pages are looked up.  The ``frequent`` runs on most pages are broadcast; if there are
    more, the others are joined with the runs of the pages, and shuffled with them.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][^:]*://([^/?#]*)", 1), F.lit(""))
    rows = small_batches(pages).select("page_id", "url", "html", F.lower(host).alias("host"))
    rows = rows.withColumn("row", F.xxhash64("page_id", "url"))  # rows that share it only look up each other's runs as well

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[Block]], list[str]]]:
        for batch in batches:
            for at in range(0, batch.num_rows, pages_per_shard):
                part = batch.slice(at, pages_per_shard)
                yield part, [blocks(x.as_py() or "") for x in part["html"]], part["host"].to_pylist()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, hosts in shards(batches):
            named, counts = shard_runs(found, hosts)
            yield pa.RecordBatch.from_arrays([pa.array(named[:, 0]), pa.array(named[:, 1]), pa.array(counts.astype(np.int64))], names=["a", "b", "n"])

    told = rows.select("html", "host").mapInArrow(tell, "a long, b long, n long")
    runs = materialize(told.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES), "runs")
    top = runs.orderBy(F.desc("n"), "a", "b").limit(frequent).toArrow()
    listed = pages.sparkSession.sparkContext.broadcast(_sorted(top))
    rows = rows.withColumn("more", F.lit(None).cast("array<struct<a:long,b:long>>"))
    if runs.count() > frequent:
        rows = _with_rarer(rows, runs, top, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, hosts in shards(batches):
            more = part["more"].flatten()
            more = _sorted(pa.table([more.field("a"), more.field("b")], names=["a", "b"]))
            texts = shard_texts(found, hosts, [listed.value, more])
            columns = [part["page_id"], part["url"], pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([g for _, g in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_repeated"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_repeated long")


def _with_rarer(rows: DataFrame, runs: DataFrame, top: pa.Table, shards) -> DataFrame:
    """``rows`` with the runs of ``runs`` that stand on a page and may not be in ``top`` as ``more``."""
    least = min(top["n"].to_pylist(), default=None)
    rest = runs if least is None else runs.where(F.col("n") <= least)
    listed = rows.sparkSession.sparkContext.broadcast(_sorted(top))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, hosts in shards(batches):
            stream, page, _, number = streams(found, hosts)
            starts, _ = _ranked(stream, page, RUN)
            named = names(stream, starts, number, RUN)
            new = np.flatnonzero(~known(named, listed.value))
            key = part["row"].to_numpy(zero_copy_only=False)[page[starts[new]]]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(named[new, 0]), pa.array(named[new, 1])], names=["row", "a", "b"])

    on_page = rows.select("row", "html", "host").mapInArrow(tell, "row long, a long, b long").join(rest.select("a", "b"), ["a", "b"])
    lists = on_page.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("more"))
    return rows.drop("more").join(lists, "row", "left")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``: null html as empty, repeated rows a row each, a null url a host of its own."""
    from weft.llm.common import table

    return extract(table(spark, sf_dir, "pages"))
