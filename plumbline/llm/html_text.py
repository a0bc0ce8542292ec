"""Operator 10. HTML extraction with suffix arrays over hosts.

Each page becomes blocks of text in page order. A block has a place, the path of elements and classes
it stands in, and a mark: in the article, in page furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments), or in neither. Blocks inside an article are kept, also where articles
share a passage. All other blocks of a page are its token stream. The pages of a host, in groups of bounded
size, are concatenated; a suffix array finds the distinct runs of ``LEAST_RUN`` tokens of each group and the
pages that have them, and a shuffle by run counts pages over all groups of the host. So the result
doesn't depend on how a host is grouped. The union of the runs on ``LEAST_PAGES`` different pages is that of all
longer substrings these pages repeat.

The share of a place's tokens that repeats cover, over the whole host, says what it is:

* from ``TEMPLATE`` on the place is a part of the host's template. Furniture there goes. In blocks without a mark covered
  runs are cut and unique ones stay; from ``ALL_TEMPLATE`` on nothing stays;
* below, the place holds text of the pages' own; a block without a mark is kept as it is.

Furniture whose place repeats don't show (a host of few pages, adverts and comments that are new on each page)
goes by its mark.

Edge cases: a null or empty html gives an empty text; markup that is never closed
ends with the page; unknown character references stay as written; pages without a
host are one host; pages with the same blocks count as one page; repeated rows each give a row; an empty table
gives no rows; extra columns are ignored. A page must fit a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, only

#: Tokens of a repeated run, at least, and distinct pages that must have it.
LEAST_RUN, LEAST_PAGES = 5, 3
#: Shares of a place's tokens from which on it is a part of the template, and nothing else.
TEMPLATE, ALL_TEMPLATE = 0.4, 0.9
#: Pages of a host that share a suffix array and their tokens outside articles, on average.
GROUP_PAGES, GROUP_TOKENS = 128, 500_000
#: Hosts with more than a group's pages that a broadcast may list.
BROADCAST_HOSTS = 200_000
#: Hashes of words that a task keeps.
CACHE = 500_000

# Elements by their part in a page.
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
_FURNITURE = set("nav header footer aside form menu dialog search select button datalist fieldset label".split())
_HIDDEN = set("script style noscript template iframe object svg canvas audio video map textarea title noframes noembed math".split())
_RAW = set("script style noscript template iframe textarea title noframes noembed xmp svg math".split())
_EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_CLASSES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|masthead|footer|(?:site|page|global|main|top)-?header|"
    r"side-?bar|aside|widget|notices?|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|"
    r"related|recommended|comments?|commentlist|replies|reply|respond|disqus|discussion|pagination|pager|toolbar|skip-link)(?:$|[\s_-])"
)
#: What marks an article that is a reader's comment.
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond)(?:$|[\s_-])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NUMBER = re.compile(r"\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _RAW}
_PARAGRAPH_ENDS = _BLOCKS - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "body", "html", "head", "title", "legend"}

FURNITURE, NEITHER, ARTICLE = 0, 1, 2


def _furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in _FURNITURE and not (name == "header" and in_article):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key in ("class", "id") and name not in ("body", "html") and (_COMMENT if name in ("article", "main") else _CLASSES).search(value):
            return True
        if key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _label(name: str, attributes: str) -> str:
    """An element's part of a place: its name and class, without numbers."""
    found = _CLASS.search(attributes) if "class" in attributes else None
    return f"{name}.{_NUMBER.sub('', next(v for v in found.groups() if v is not None))}" if found else name


def blocks(html: str | None) -> list[tuple[str, int, int]]:
    """(text, mark, place) of each block in page order; white space is one space, ends are trimmed."""
    html = html or ""
    found: list[tuple[str, int, int]] = []
    text: list[str] = []
    open_: list[tuple[str, bool, bool, str]] = []  # name, furniture, article, label
    furniture = article = 0

    def flush() -> None:
        if text:
            if words := unescape("".join(text)).split():
                place = crc32("/".join(label for *_, label in open_ if label).encode()) - (1 << 31)
                found.append((" ".join(words), FURNITURE if furniture else ARTICLE if article else NEITHER, place))
            text.clear()

    def close(depth: int) -> None:
        nonlocal furniture, article
        while len(open_) > depth:
            _, f, a, _ = open_.pop()
            furniture, article = furniture - f, article - a

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if not m:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        closing, name = m[2], (m[3] or "").lower()
        if not name:
            if m[1]:
                text.append(m[1])
            continue
        if closing:
            where = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
            # An end tag doesn't reach out of the article or the furniture around it.
            if name in _BLOCKS:
                flush()
            if where is not None and (name in _BLOCKS or not any(x[0] in _BLOCKS for x in open_[where + 1 :])):
                close(where)
            continue
        if name in _BLOCKS or name == "br":
            if name != "br":
                flush()
            else:
                text.append(" ")
        if name in _PARAGRAPH_ENDS:  # an open paragraph, or an open item before a new one, ends here
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == "p" or open_[i][0] == name == "li" or {open_[i][0], name} <= {"dt", "dd"}:
                    close(i)
                    break
                if open_[i][0] in _BLOCKS:
                    break
        if name in _RAW or name in _HIDDEN:
            if not m[4].endswith("/"):
                stop = (_RAW_END.get(name) or re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE)).search(html, at)
                at = html.find(">", stop.end()) + 1 or end if stop else end
            continue
        if name in _EMPTY or m[4].endswith("/"):
            continue
        f, a = _furniture(name, m[4], bool(article)), name in ("article", "main")
        open_.append((name, f, a, _label(name, m[4]) if name in _BLOCKS else ""))
        furniture, article = furniture + f, article + a
    flush()
    return found


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the next ``depth`` tokens at least, by doubling of ranks."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank, n, k = rank.astype(np.int64), len(tokens), 1
    while k < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - k, 0)] = rank[k:] + 1
        _, rank = np.unique(rank * np.int64(n + 1) + ahead, return_inverse=True)
        rank, k = rank.astype(np.int64), 2 * k
    return np.argsort(rank, kind="stable")


def shared_runs(streams: list[np.ndarray], owners: list[int], least: int = LEAST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All streams with a mark after each one, the starts of runs of ``least`` tokens in the order of the suffix array, the number
    of each start's run, and that of its owner."""
    if not streams:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    tokens = np.concatenate([np.append(s, np.uint64(i)) for i, s in enumerate(streams)])  # so runs stay inside pages
    _, page = np.unique(np.asarray(owners), return_inverse=True)
    inside = np.concatenate([np.arange(len(s), -1, -1) >= least for s in streams])
    order = suffix_array(tokens, least)
    order = order[inside[order]]
    if not len(order):
        return tokens, order, order, order
    same = np.ones(len(order) - 1, bool)
    for k in range(least):
        same &= tokens[order[1:] + k] == tokens[order[:-1] + k]
    run = np.concatenate([[0], np.cumsum(~same)])
    return tokens, order, run, page[np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])[order]]


def repeated(streams: list[np.ndarray], least: int = LEAST_RUN, pages: int = LEAST_PAGES) -> list[np.ndarray]:
    """For each page's tokens, which are in a run of ``least`` tokens that ``pages`` different pages have."""
    distinct: dict[bytes, int] = {}
    tokens, order, run, owner = shared_runs(streams, [distinct.setdefault(s.tobytes(), len(distinct)) for s in streams], least)
    pair = np.unique(run * np.int64(len(distinct)) + owner)
    held = np.bincount(pair // max(len(distinct), 1), minlength=len(order) + 1)
    cover, at, out = spread(order[held[run] >= pages], len(tokens), least), 0, []
    for s in streams:
        out.append(cover[at : at + len(s)])
        at += len(s) + 1
    return out


def spread(starts: np.ndarray, length: int, least: int) -> np.ndarray:
    """Which of ``length`` tokens are in a run from one of the starts."""
    edge = np.zeros(length + least + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    return np.cumsum(edge)[:length] > 0


def run_keys(stream: np.ndarray, host: str, least: int = LEAST_RUN) -> np.ndarray:
    """A key for each run of ``least`` tokens, another on each host."""
    n = max(len(stream) - least + 1, 0)
    key = np.full(n, xxhash.xxh3_64_intdigest(host), np.uint64)
    for k in range(least):
        key = mix64(key + stream[k : k + n])
    return key.view(np.int64)


class _Streams:
    """Token streams of pages; keeps the hashes of words."""

    def __init__(self):
        self.hashes: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        words, hashes = " ".join(texts).split(" ") if len(texts) else [], self.hashes
        if len(hashes) > CACHE:
            hashes.clear()
        for w in set(words).difference(hashes):
            hashes[w] = xxhash.xxh3_64_intdigest(w) | 1 << 63  # never a mark between pages
        return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def extracted(found: list[tuple[str, int, int]], cover: np.ndarray, shares: dict[int, float]) -> tuple[str, int, int]:
    """A page's text, and how many characters of its blocks went by repeats and by marks alone.

    cover: of the tokens outside articles, which repeats cover; shares: of the template's places.
    """
    at, kept, gone = 0, [], [0, 0]
    for text, mark, place in found:
        if mark == ARTICLE:
            kept.append(text)
            continue
        n, share = text.count(" ") + 1, shares.get(place, 0.0)
        own, at = cover[at : at + n], at + n
        if mark == FURNITURE or share >= ALL_TEMPLATE:
            gone[share < TEMPLATE] += len(text)
        elif share >= TEMPLATE and own.any():
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
            cut = own.copy()
            for a, b in edges:  # a run that only reaches over the block's edge cuts nothing off it
                cut[a:b] = b - a >= min(LEAST_RUN, n)
            rest = " ".join(w for w, c in zip(text.split(" "), cut.tolist()) if not c)
            gone[0] += len(text) - len(rest)
            if rest:
                kept.append(rest)
        else:
            kept.append(text)
    return "\n".join(kept), *gone


PARSED = "page_id long, url string, host string, page long, texts array<string>, marks array<int>, places array<int>, body binary, tokens long"
PAGES = "page_id long, url string, text string, n_chars long, repeat_chars long, marked_chars long"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def folded(found: list[tuple[str, int, int]]) -> tuple[list[tuple[str, int, int]], str]:
    """The blocks with each stretch of an article's as one, which has no text and the number of its lines in place of a place;
    and the text of these lines. Nothing looks into it again, so it travels compressed."""
    out, lines = [], []
    for mark, own in groupby(found, key=lambda b: b[1]):
        own = list(own)
        if mark == ARTICLE:
            out.append(("", ARTICLE, len(own)))
            lines += [t for t, *_ in own]
        else:
            out += own
    return out, "\n".join(lines)


def unfolded(found: Iterable[tuple[str, int, int]], body: str) -> Iterator[tuple[str, int, int]]:
    """The blocks again, each stretch of an article's as one."""
    lines, at = body.split("\n"), 0
    for text, mark, place in found:
        if mark == ARTICLE:
            text, at = "\n".join(lines[at : at + place]), at + place
        yield text, mark, place


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    compress = zstandard.ZstdCompressor()
    for rows in batches:
        for part in np.array_split(np.arange(len(rows)), -(-len(rows) // 256)) if len(rows) else ():
            some = rows.iloc[part]
            found = [blocks(h) for h in some.html]
            page = np.array([xxhash.xxh3_64_intdigest("\n".join(t for t, *_ in f)) for f in found], np.uint64).view(np.int64)
            found, bodies = zip(*map(folded, found))
            yield pd.DataFrame({
                "page_id": some.page_id.astype("Int64"), "url": some.url, "host": some.host, "page": page, "texts": [[t for t, *_ in f] for f in found], "marks": [[m for _, m, _ in f] for f in found],
                "places": [[p for *_, p in f] for f in found], "body": [compress.compress(b.encode()) for b in bodies], "tokens": [sum(t.count(" ") + 1 for t, m, _ in f if m != ARTICLE) for f in found],
            })


def _runs(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a group of pages: each distinct run's key with up to ``LEAST_PAGES`` different pages that have it."""
    streams, host = _Streams(), rows.host.iloc[0]
    tokens, order, run, owner = shared_runs([streams(t) for t in rows.texts], rows.page.tolist())
    names = np.unique(rows.page.to_numpy(np.int64))
    pair = np.unique(run * np.int64(len(names)) + owner)
    which = pair // len(names)
    ahead = np.arange(len(pair)) - np.searchsorted(which, which)  # pages of the same run before this one
    pair, which = pair[ahead < LEAST_PAGES], which[ahead < LEAST_PAGES]
    first = order[np.searchsorted(run, which)]
    key = np.full(len(which), xxhash.xxh3_64_intdigest(host), np.uint64)
    for k in range(LEAST_RUN):
        key = mix64(key + tokens[first + k])
    return pd.DataFrame({"key": key.view(np.int64), "page": names[pair % len(names)], "group": rows.group.iloc[0]})


def _covers(rows: pd.DataFrame, keys: np.ndarray, texts: list[list[str]]) -> Iterator[np.ndarray]:
    """The tokens of each page's texts that runs with these keys cover."""
    streams = _Streams()
    for host, own in zip(rows.host, texts):
        stream = streams(own)
        yield spread(np.flatnonzero(np.isin(run_keys(stream, host), keys)), len(stream), LEAST_RUN)


def _tally(rows: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """Of a group of pages: tokens and covered tokens of each place."""
    if not len(rows):
        return pd.DataFrame({c: [] for c in ("host", "place", "covered", "tokens")})
    size = [t.count(" ") + 1 for own in rows.texts for t in own]
    place = np.repeat(np.concatenate([np.asarray(p, np.int64) for p in rows.places]), size)
    cover = np.concatenate([*_covers(rows, keys.key.to_numpy(np.int64), rows.texts)])
    names, at = np.unique(place, return_inverse=True)
    return pd.DataFrame({"host": rows.host.iloc[0], "place": names, "covered": np.bincount(at, cover), "tokens": np.bincount(at)}).astype({"covered": "int64"})


def _extract(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """The texts of a group of pages. told: the keys of repeated runs, and the shares of the template's places."""
    if not len(rows):
        return pd.DataFrame({c: [] for c in _columns(PAGES)})
    keys, places = told[told.share.isna()], told[told.share.notna()]
    shares = dict(zip(places.key.tolist(), places.share.tolist()))
    expand = zstandard.ZstdDecompressor()
    found = [list(unfolded(zip(t, m, p), expand.decompress(b).decode() if b else "")) for t, m, p, b in zip(rows.texts, rows.marks, rows.places, rows.body)]
    cover = _covers(rows, keys.key.to_numpy(np.int64), [[t for t, m, _ in f if m != ARTICLE] for f in found])
    out = [extracted(f, c, shares) for f, c in zip(found, cover)]
    return pd.DataFrame({
        "page_id": rows.page_id.astype("Int64"), "url": rows.url, "text": [t for t, *_ in out], "n_chars": [len(t) for t, *_ in out],
        "repeat_chars": [r for _, r, _ in out], "marked_chars": [m for *_, m in out],
    })


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages``, and the characters that went by repeats and by marks alone.

    A host is dealt by a hash into as many groups as it needs.
    """
    pages = only(pages, page_id="page_id", url="url", html="html")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    scratch = Scratch(pages.sparkSession, "html")
    parsed = pages.withColumn("host", host).mapInPandas(_parse, PARSED).withColumn("salt", F.monotonically_increasing_id())
    parsed = scratch.write(parsed, "parsed")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_PAGES), F.ceil(F.sum("tokens") / GROUP_TOKENS)).cast("int").alias("parts")
    large = parsed.groupBy("host").agg(parts).where("parts > 1")
    if large.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    part = F.pmod(F.xxhash64("salt"), F.coalesce("parts", F.lit(1)))
    dealt = parsed.join(large, "host", "left").withColumn("group", F.xxhash64("host", part)).drop("parts", "salt", "tokens")
    blocks_ = F.filter(F.arrays_zip("texts", "marks", "places"), lambda b: b["marks"] != ARTICLE)
    open_ = dealt.withColumn("b", blocks_).where(F.size("b") > 0).select("group", "host", "page", F.col("b.texts").alias("texts"), F.col("b.places").alias("places"))

    runs = scratch.write(open_.select("group", "host", "page", "texts").groupBy("group").applyInPandas(_runs, "key long, page long, group long"), "runs")
    often = runs.select("key", "page").distinct().groupBy("key").count().where(F.col("count") >= LEAST_PAGES).select("key")
    keys = scratch.write(runs.select("key", "group").distinct().join(often, "key"), "keys")
    scratch.drop("runs")
    tally = open_.select("group", "host", "texts", "places").groupBy("group").cogroup(keys.groupBy("group")).applyInPandas(_tally, "host string, place long, covered long, tokens long")
    share = (F.sum("covered") / F.sum("tokens")).alias("share")
    places = scratch.write(tally.groupBy("host", "place").agg(share).where(F.col("share") >= TEMPLATE), "places")
    groups = dealt.select("group", "host").distinct()
    told = keys.select("group", "key", F.lit(None).cast("double").alias("share")).unionAll(groups.join(places, "host").select("group", F.col("place").alias("key"), "share"))
    return dealt.select("group", "page_id", "url", "host", "texts", "marks", "places", "body").groupBy("group").cogroup(told.groupBy("group")).applyInPandas(_extract, PAGES)
