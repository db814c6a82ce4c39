"""Main text of web pages, by suffix arrays over the pages of a host.

The token streams of a host's pages are concatenated, group by group of bounded size, and
sorted as suffixes. Neighbours that share ``MIN_RUN`` tokens or more are long substrings; one
that occurs on ``MIN_PAGES`` distinct pages of the host is boilerplate. Each group gives all
its runs, also those it sees once, so the count is exact over the whole host and does not
depend on the number of groups. Pages with equal or near-equal text count as one: minima of
hashed runs put them in common buckets, and what buckets connect is one content. Covered runs
are taken out, the others stay.

Markup says where text may not come from (menus, forms, scripts and so on) and where an
article is. Within the articles that a page declares, and its main element, texts repeat lines
of others, so there a run must also be on more than half of the host's pages that declare one, and
goes only where it covers a block as a whole. Suffix arrays over groups of their texts propose such
runs: what is on more than half of all pages is on more than half of those of a group. Without a
declared article, what is not covered is the text. If less than half would be left, the page is a
copy more than boilerplate, and what the markup allows stays.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, written

#: Tokens that a repeated substring has at least.
MIN_RUN = 6
#: Distinct pages of a host that have a boilerplate run, at least.
MIN_PAGES = 4
#: Buckets of a page, and minima that make one: pages that share 94 % of their runs meet in
#: one almost surely, those that share 40 % do in one case of 200.
BANDS, MINIMA = 8, 8
#: HTML characters in a group, about; of declared articles a quarter.
GROUP_CHARS = 2_000_000
#: Large hosts that are broadcast, at most.
MAX_BROADCAST_HOSTS = 50_000
#: Entries of a worker's memo of token numbers; at the limit it starts afresh.
MEMO = 800_000
#: Links hold at most this share of the characters of a block of text.
LINK_SHARE = 0.6

# --- markup: fixed lists of element names --------------------------------------------------
#: Elements whose content is no text of a page.
SILENT = {"script", "style", "noscript", "template", "head", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "audio", "video"}
#: Elements whose text is not the article's.
FURNITURE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "input", "label", "fieldset"}
#: Elements that break text into blocks.
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that name furniture.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner|breadcrumbs?|byline-?share|comments?|comment-?list|disqus|replies|reply|respond|cookies?|consent|gdpr|"
    r"footer|masthead|menu|nav|navbar|navigation|newsletter|notice|notification|pager|pagination|popup|modal|promo\w*|recommend\w*|related|"
    r"share|sharing|sidebar|side-?bar|skip|social|sponsor\w*|subscribe|subscription|toolbar|widget|complementary|contentinfo|search|paywall|alert)(?:$|[\s_-])",
    re.I,
)
#: The same, but only outside an article: inside it, these name its title block.
_OUTSIDE = re.compile(r"(?:^|\s)(?:(?:site|page|main|global|top)[_-]?)?(?:header|top-?bar|branding)(?:$|\s)", re.I)
#: An article element that is a reader's, not the page's.
_COMMENT = re.compile(r"(?:^|\s)(?:(?:user-?)?comments?(?:[_-](?:item|body|entry|content))?|reply|replies)(?:$|\s)", re.I)
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article-?body|articlebody|post-?content|entry-?content|story-?body|article-?content|main-?content)(?:$|[\s_-])|(?:^|\s)content(?:$|\s)", re.I)

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: A tag whose quotes never close: it ends at its first >.
_loose = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_start = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_close = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "noscript", "template", "iframe", "title")}
_attr = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_unseen = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)


class Block:
    """Text of one block: its characters, those in links, and where it stands."""

    __slots__ = ("text", "linked", "furniture", "article", "main", "heading")

    def __init__(self, text: str, linked: int, furniture: bool, article: int, main: bool, heading: bool):
        self.text, self.linked, self.furniture, self.article, self.main, self.heading = text, linked, furniture, article, main, heading


def page_blocks(html: str | None) -> list[Block]:
    """Blocks of a page in order, furniture marked; white space in each made single.

    A tag that never ends is text. One whose quotes never close ends at its first >, and from
    there on quotes in tags mean nothing. Elements may be nested to any depth.
    """
    if not html:
        return []
    blocks, parts, linked, n_articles = [], [], 0, 0
    # Open elements: name, furniture, article number, in main, in a link, heading.
    stack = [("", False, 0, False, False, False)]

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                _, furniture, article, main, _, heading = stack[-1]
                blocks.append(Block(text, linked, furniture, article, main, heading))
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if stack[-1][4]:
            linked += len(raw.strip())

    # Every part of a page is read a fixed number of times, whatever is left open in it.
    at, n, last, loose, unclosed, opened = 0, len(html), html.rfind(">"), False, set(), Counter(e[0] for e in stack)

    def close(k: int) -> None:
        opened.subtract(e[0] for e in stack[k:])
        del stack[k:]

    while at < n:
        found = _start.search(html, at) if at <= last else None
        if not found:
            rest = html.find("<!", at)  # an open comment runs to the end
            add(html[at:] if rest < 0 else html[at:rest])
            break
        p = found.start()
        m = (_loose if loose and found.group() not in ("<!", "<?") else _tag).match(html, p)
        if not m and html.find(">", p) >= 0:
            loose, m = True, _loose.match(html, p)
        if p > at:
            add(html[at:p])
        if not m:
            add(html[p])
            at = p + 1
            continue
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body", "td", "table") and name not in ("body", "html", "main", "article"):
                    break
            continue
        if name in SILENT or name == "title":
            flush()
            end = _close[name].search(html, at) if name in _close else None
            if name in _close:
                at = end.end() if end else n
            elif name != "head" and name not in unclosed and not m.group(3).rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = stop.end() if stop else at
                if not stop:
                    unclosed.add(name)
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in BLOCK:
            flush()
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                # What HTML closes by itself: an open one of the kind, with the inline elements in it.
                closes = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}.get(name, {name})
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closes:
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            elif stack[-1][0] == "p" or name in ("article", "footer", "header", "nav", "aside", "section", "div", "main"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
        if name in VOID or m.group(3).rstrip().endswith("/"):
            continue
        _, furniture, article, main, link, heading = stack[-1]
        raw = m.group(3)
        hint = body = False
        if "=" in raw or "hidden" in raw.lower():
            attrs = {k.lower(): a or b or c for k, a, b, c in _attr.findall(raw)}
            named = " ".join(attrs[k] for k in ("class", "id", "role") if k in attrs)
            hint = bool(named and (HINT.search(named) or not (article or main) and _OUTSIDE.search(named))) or attrs.get("aria-hidden") == "true"
            body = bool(named and _ARTICLE.search(named)) or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody"
            hint = hint and not (body or name in ("html", "body", "article", "main"))
            hint = hint or name == "article" and bool(_COMMENT.search(named))
            # A hidden page is one that a script shows.
            hint = hint or ("hidden" in attrs or bool(_unseen.search(attrs.get("style", "")))) and name not in ("html", "body")
        if name == "article" or body:
            if not article or name == "article":
                n_articles += 1
                article = n_articles
        elif name == "header" and not (article or main):
            hint = True
        stack.append((name, furniture or hint or name in FURNITURE, article, main or name == "main", link or name == "a", heading or name in ("h1", "h2", "h3", "h4", "h5", "h6")))
        opened[name] += 1
    flush()
    return blocks


# --- suffixes ------------------------------------------------------------------------------
def token_hashes(blocks: list[Block], memo: dict[str, int]) -> np.ndarray:
    """A 64-bit number for each token of a page, one more at the end that matches nothing."""
    out = []
    for b in blocks:
        for w in b.text.split(" "):
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
            out.append(h)
    return np.array(out, np.uint64)


def windows(x: np.ndarray, run: int = MIN_RUN) -> np.ndarray:
    """A number for each place where ``run`` tokens follow: that of these tokens."""
    n = len(x) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(run):
        h = (h ^ x[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def substrings(pages: list[np.ndarray], run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All substrings of ``run`` tokens: numbers, where in the last array each begins, its pages in order.

    The suffixes of the concatenated pages are put in order of their first ``run`` tokens by
    prefix doubling; equal neighbours share them. Suffixes that reach into the next page are
    left out.
    """
    lengths = np.array([len(p) for p in pages])
    if not len(lengths) or lengths.max(initial=0) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.concatenate(pages)
    page = np.repeat(np.arange(len(pages)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text))  # tokens to the page's end
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        # Ranks of the first ``width + step`` tokens from those of ``width``.
        step = min(width, run - width)
        ahead = np.full(len(rank), -1, np.int64)
        ahead[: len(rank) - step] = rank[step:]
        ahead[left <= step] = -1
        rank = np.unique(rank * (len(rank) + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    whole = left >= run
    suffixes = np.flatnonzero(whole)
    order = suffixes[np.lexsort((page[suffixes], rank[suffixes]))]
    new = np.ones(len(order), bool)
    new[1:] = (rank[order][1:] != rank[order][:-1]) | (page[order][1:] != page[order][:-1])
    firsts = order[new]
    begin = np.unique(rank[firsts], return_index=True)[1]
    at = firsts[begin]
    ids = np.concatenate([windows(p, run) if len(p) >= run else np.zeros(0, np.int64) for p in pages])
    # Place of a suffix among the windows: page ends have run - 1 suffixes without one.
    offset = np.cumsum(np.where(lengths >= run, run - 1, lengths)) - np.where(lengths >= run, run - 1, lengths)
    return ids[at - offset[page[at]]], begin, page[firsts]


def repeated(pages: list[np.ndarray], run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Substrings of ``run`` tokens on two pages or more, with their numbers of pages."""
    ids, begin, on = substrings(pages, run)
    count = np.diff(np.append(begin, len(on)))
    return ids[count > 1], count[count > 1]


_FACTORS = np.random.default_rng(11).integers(1, 2**63, size=(BANDS * MINIMA, 1), dtype=np.uint64) | np.uint64(1)


def buckets(x: np.ndarray) -> list[int]:
    """Numbers that near-equal token streams share; none for one without a run."""
    w = np.unique(windows(x)).view(np.uint64)
    if not len(w):
        return []
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(w), 8192):
        h = w[at : at + 8192] * _FACTORS
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, (h ^ (h >> np.uint64(29))).min(axis=1))
    return [xxhash.xxh3_64_intdigest(b.tobytes(), seed=k) - 2**63 for k, b in enumerate(least.reshape(BANDS, MINIMA))]


def frequent(pages: list[np.ndarray], run: int = MIN_RUN) -> np.ndarray:
    """Substrings of ``run`` tokens on more than half of the pages."""
    ids, begin, on = substrings(pages, run)
    return ids[2 * np.diff(np.append(begin, len(on))) > len(pages)]


def contents(ids: np.ndarray, begin: np.ndarray, on: np.ndarray, content: np.ndarray, most: int = MIN_PAGES) -> pa.ListArray:
    """For each of ``substrings``, up to ``most`` different contents of the pages that have it."""
    number = np.repeat(np.arange(len(ids)), np.diff(np.append(begin, len(on))))
    c = content[on]
    order = np.lexsort((c, number))
    number, c = number[order], c[order]
    new = np.ones(len(c), bool)
    new[1:] = (number[1:] != number[:-1]) | (c[1:] != c[:-1])
    number, c = number[new], c[new]
    first = np.searchsorted(number, np.arange(len(ids)))
    keep = np.arange(len(c)) - first[number] < most
    ends = np.cumsum(np.bincount(number[keep], minlength=len(ids)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(c[keep], pa.int64()))


def covered(x: np.ndarray, boiler: np.ndarray, run: int = MIN_RUN) -> np.ndarray:
    """True for each token in a window that is boilerplate (``boiler`` ascending)."""
    w = windows(x, run)
    out = np.zeros(len(x) + 1, np.int64)
    if len(w) and len(boiler):
        at = np.flatnonzero(boiler[np.minimum(np.searchsorted(boiler, w), len(boiler) - 1)] == w)
        np.add.at(out, at, 1)
        np.add.at(out, at + run, -1)
    return np.cumsum(out)[:-1] > 0


def declares(blocks: list[Block]) -> bool:
    """True if a page has text in an article or main element that it declares."""
    return any((b.article or b.main) and not b.furniture for b in blocks)


def lines(text: str) -> list[Block]:
    """Blocks of a text that a page declares."""
    return [Block(t, 0, False, 1, False, False) for t in text.split("\n")]


def main_text(blocks: list[Block], cover: np.ndarray | None = None) -> str:
    """Article text from a page's blocks and which of its tokens are covered, if any.

    All declared articles and the main element around or beside them are the text, in page
    order; without any, the whole page. Inside a declared region what the markup marks goes, and
    blocks that are covered as a whole; elsewhere covered runs and blocks of links go too.
    """
    known, spans, at = declares(blocks), [], 0
    for b in blocks:
        n = b.text.count(" ") + 1
        spans.append((at, at + n))
        at += n
    cover = np.zeros(at, bool) if cover is None else cover
    wanted = lambda b: b.article or b.main if known else b.heading or b.linked <= LINK_SHARE * len(b.text)
    allowed = [(b, s, e) for b, (s, e) in zip(blocks, spans) if not b.furniture and wanted(b)]
    if not cover.any():
        return "\n".join(b.text for b, _, _ in allowed)
    out, left = [], 0
    for b, s, e in allowed:
        # A run counts in a block if it is the whole block, or outside articles long enough within it.
        words, own, kept = b.text.split(" "), cover[s:e], []
        if not own.any():
            out.append(b.text)
            left += e - s
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
        least = len(words) if known else min(MIN_RUN, len(words))
        at = 0
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if last - first >= least:
                kept += words[at:first]
                at = last
        kept += words[at:]
        if kept:
            out.append(" ".join(kept))
            left += len(kept)
    return "\n".join(out if 2 * left >= sum(e - s for _, s, e in allowed) else [b.text for b, _, _ in allowed])


def host_of(url: str = "url") -> F.Column:
    """Host of an address, lower-cased; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def near_equal(pages: DataFrame) -> DataFrame:
    """Of pages (host, content, buckets), those contents that buckets connect to others: host, content, label.

    The label is the least content that is connected. Each round takes the least label of a
    content's buckets, then the label of that, until none changes.
    """
    edges = pages.select("host", "content", F.explode("buckets").alias("bucket")).distinct()
    shared = edges.groupBy("host", "bucket").count().where("count > 1").select("host", "bucket")
    edges = written(edges.join(shared, ["host", "bucket"]), "near-edges")
    labels = written(edges.select("host", "content", F.col("content").alias("label")).distinct(), "near-labels")
    while True:
        low = edges.join(labels, ["host", "content"]).groupBy("host", "bucket").agg(F.min("label").alias("low"))
        new = written(edges.join(low, ["host", "bucket"]).groupBy("host", "content").agg(F.min("low").alias("label")), "near-labels")
        after = new.select("host", F.col("content").alias("label"), F.col("label").alias("next"))
        new = written(new.join(after, ["host", "label"]).select("host", "content", F.col("next").alias("label")), "near-labels")
        old = labels.withColumnRenamed("label", "old")
        same = new.join(old, ["host", "content"]).where("label <> old").isEmpty()
        labels = new
        if same:
            return labels


def cut_shared(first: DataFrame, group_chars: int) -> DataFrame:
    """Of pages (host, h, text and more) with a declared text, ``text`` without the blocks that most of a host's pages share.

    Groups of a host's texts propose runs by the low 16 bits of their tokens; proposed runs are then
    counted by whole tokens, over all pages and contents of the host.
    """
    texts = first.where("text <> ''")
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("n"))
    hosts = written(hosts.where(F.col("pages") >= MIN_PAGES).select("host", "pages", F.ceil(F.col("n") * 4 / group_chars).cast("int").alias("groups")), "declared-hosts")
    n = hosts.count()
    if not n:
        return first

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            if len(memo) > MEMO:
                memo.clear()
            tokens = [token_hashes(lines(t), memo).astype(np.uint16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("part"), pa.array(tokens, pa.binary())], ["host", "part", "tokens"])

    def proposed(key: tuple, table: pa.Table) -> pa.Table:
        runs = frequent([np.frombuffer(t, np.uint16).astype(np.uint64) for t in table.column("tokens").to_pylist()])
        return pa.table([pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(runs)), pa.array(runs, pa.int64())], names=["host", "run"])

    dealt = texts.join(F.broadcast(hosts) if n <= MAX_BROADCAST_HOSTS else hosts, "host")
    dealt = dealt.select("host", F.pmod("h", F.col("groups")).cast("int").alias("part"), "text")
    often = dealt.mapInArrow(short, "host string, part int, tokens binary").groupBy("host", "part").applyInArrow(proposed, "host string, run bigint")
    often = written(often, "proposed-runs")
    if often.isEmpty():
        return first

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            if len(memo) > MEMO:
                memo.clear()
            out = []
            for host, text, runs in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist(), batch.column("runs")):
                x = token_hashes(lines(text), memo)
                w, runs = windows(x.astype(np.uint16).astype(np.uint64)), runs.values.to_numpy()
                at = runs[np.minimum(np.searchsorted(runs, w), len(runs) - 1)] == w
                if at.any():
                    out.append((host, xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63, buckets(x), np.unique(windows(x)[at])))
            cols = zip(("host", "content", "buckets", "runs"), zip(*out) if out else ((),) * 4, (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_pydict({c: pa.array(list(v), t) for c, v, t in cols})

    runs = often.groupBy("host").agg(F.sort_array(F.collect_set("run")).alias("runs"))
    hits = texts.join(runs, "host").select("host", "text", "runs").mapInArrow(hit, "host string, content bigint, buckets array<bigint>, runs array<bigint>")
    hits = written(hits, "proposed-hits")
    # One content for equal and near-equal pages, as where no article is declared.
    hits = hits.join(near_equal(hits.drop("runs")), ["host", "content"], "left").select("host", F.coalesce("label", "content").alias("content"), F.explode("runs").alias("run"))
    counts = hits.groupBy("host", "run", "content").count().groupBy("host", "run").agg(F.sum("count").alias("on"), F.count(F.lit(1)).alias("contents"))
    most = counts.join(hosts, "host").where((F.col("contents") >= MIN_PAGES) & (2 * F.col("on") > F.col("pages")))
    most = written(most.groupBy("host").agg(F.sort_array(F.collect_list("run")).alias("boiler")), "shared-runs")
    if most.isEmpty():
        return first

    names = first.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            if len(memo) > MEMO:
                memo.clear()
            out = []
            for text, boiler in zip(batch.column("text").to_pylist(), batch.column("boiler")):
                blocks = lines(text) if text and boiler.is_valid else []
                out.append(main_text(blocks, covered(token_hashes(blocks, memo), boiler.values.to_numpy())) if blocks else text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(out, pa.string())).select(names)

    return first.join(most, "host", "left").select(*names, "boiler").mapInArrow(cut, first.schema)


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", group_chars: int = GROUP_CHARS, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``pages`` with new columns ``text`` (never null) and ``n_chars`` (long).

    Null or empty html gives an empty text. Pages without a host form a group of their own.
    A host with many pages is dealt out to as many groups as its characters ask for, by a hash
    of the row; the groups bound memory and decide no result. Pages with equal or near-equal
    text outside furniture count as one page. Old columns of the new names give way; ``keep`` names the old
    columns wanted, all by default.

    Runs of declared articles are counted on every host, see :func:`cut_shared`; those of whole
    pages on hosts that have a page without a declared article: on others they could cut nothing.
    """
    schema = add_columns(pages, text=F.lit("x"), n_chars=F.lit(0).cast("long")).schema
    kept = [f for f in schema.fields[:-2] if keep is None or f.name in keep]
    names = [f.name for f in kept] + ["text", "n_chars"]
    others = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(kept)]
    host, row = host_of(url), F.xxhash64(url, html)
    source = pages.select(*[F.col(f"`{f.name}`").alias(o.name) for f, o in zip(kept, others)], F.col(f"`{html}`").alias("html"), host.alias("host"), row.alias("h"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The text of a page that declares an article; the blocks of another.
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                text, left, chars = [], [], []
                for h in rows.column("html").to_pylist():
                    blocks = page_blocks(h)
                    known = not blocks or declares(blocks)
                    text.append(main_text(blocks) if known else None)
                    left.append(None if known else json.dumps([[b.text, b.linked, b.furniture, b.heading] for b in blocks]))
                    chars.append(len(h or ""))
                cols = [rows.column(n) for n in (*[o.name for o in others], "host", "h")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(text, pa.string()), pa.array(left, pa.string()), pa.array(chars, pa.int64())], [*[o.name for o in others], "host", "h", "text", "left", "chars"])

    new = [("host", "string"), ("h", "bigint"), ("text", "string"), ("left", "string"), ("chars", "bigint")]
    first = T.StructType(others + [T.StructField(n, {"string": T.StringType(), "bigint": T.LongType()}[t]) for n, t in new])
    first = written(source.mapInArrow(parsed, first), "parsed")
    done = cut_shared(first.where("left IS NULL").select(*[o.name for o in others], "host", "h", "text"), group_chars)
    done = done.select(*[F.col(o.name).alias(n) for o, n in zip(others, names)], F.col("text"), F.length("text").cast("long").alias("n_chars"))
    sizes = first.groupBy("host").agg(F.sum("chars").alias("chars"), F.max(F.col("left").isNotNull()).alias("open")).where("open")
    groups = written(sizes.select("host", F.greatest(F.lit(1), F.ceil(F.col("chars") / group_chars)).cast("int").alias("groups")), "hosts")
    n = groups.count()
    if not n:
        return done
    # Joined without moving pages while there are few such hosts; else Spark chooses.
    if n <= MAX_BROADCAST_HOSTS:
        groups = F.broadcast(groups)
    part = F.pmod("h", F.col("groups")).cast("int").alias("part")

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                if len(memo) > MEMO:
                    memo.clear()
                tokens, content, near, is_open = [], [], [], []
                for h in rows.column("html").to_pylist():
                    blocks = page_blocks(h)
                    tokens.append(token_hashes(blocks, memo).tobytes())
                    own = token_hashes([b for b in blocks if not b.furniture], memo)
                    content.append(xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63)
                    near.append(buckets(own))
                    is_open.append(not declares(blocks))
                yield pa.RecordBatch.from_arrays([rows.column("host"), rows.column("part"), pa.array(tokens, pa.binary()), pa.array(content, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(is_open)], ["host", "part", "tokens", "content", "buckets", "open"])

    tokens = source.select("host", "html", "h").join(groups, "host").select("host", part, "html")
    tokens = written(tokens.mapInArrow(tokenized, "host string, part int, tokens binary, content bigint, buckets array<bigint>, open boolean"), "tokens")
    # One content for equal and near-equal pages.
    tokens = tokens.drop("buckets").join(near_equal(tokens), ["host", "content"], "left")
    tokens = tokens.select("host", "part", "tokens", F.coalesce("label", "content").alias("content"), "open")

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        pages = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        ids, begin, on = substrings(pages)
        if not len(ids):
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_())], names=["host", "part", "run", "contents", "open"])
        is_open = np.logical_or.reduceat(np.array(table.column("open").to_pylist(), bool)[on], begin)
        same = [pa.repeat(pa.scalar(key[k].as_py(), t), len(ids)) for k, t in ((0, pa.string()), (1, pa.int32()))]
        lists = contents(ids, begin, on, table.column("content").to_numpy())
        return pa.table([*same, pa.array(ids), lists, pa.array(is_open)], names=["host", "part", "run", "contents", "open"])

    runs = tokens.groupBy("host", "part").applyInArrow(counted, "host string, part int, run bigint, contents array<bigint>, open boolean")
    runs = written(runs, "runs")
    # A group gives no more contents of a run than decide, so a run on all pages is few rows.
    boiler = runs.select("host", "run", F.explode("contents").alias("c")).distinct().groupBy("host", "run").count().where(F.col("count") >= MIN_PAGES)
    boiler = runs.where("open").select("host", "part", "run").join(boiler.select("host", "run"), ["host", "run"])

    def texts(key: tuple, table: pa.Table, boiler: pa.Table) -> pa.Table:
        memo: dict[str, int] = {}
        known = np.sort(boiler.column("run").to_numpy()) if boiler.num_rows else np.zeros(0, np.int64)
        out = []
        for left in table.column("left").to_pylist():
            blocks = [Block(t, linked, furniture, 0, False, heading) for t, linked, furniture, heading in json.loads(left)]
            out.append(main_text(blocks, covered(token_hashes(blocks, memo), known)))
        cols = [table.column(o.name) for o in others] + [pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())]
        return pa.table(cols, names=names)

    rest = first.where("left IS NOT NULL").join(groups, "host").select(*[o.name for o in others], "host", part, "left")
    out = T.StructType([T.StructField(n, o.dataType) for n, o in zip(names, others)] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return done.unionByName(rest.groupBy("host", "part").cogroup(boiler.groupBy("host", "part")).applyInArrow(texts, out))
