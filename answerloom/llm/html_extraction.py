"""Main texts of web pages: what their markup declares or leaves open, without what their host repeats.

A page becomes blocks of text in page order, and all pages of a host are judged together: their token streams are
concatenated, suffixes are named by their first 1, 2, 4 and 8 tokens (a name of two names at each doubling), and sorted by
host and name, so substrings that distinct pages share stand together. Blocks that repeated substrings cover are
boilerplate. Where the markup declares an article (or else a main part), the text is taken from its blocks, and only what
most articles of the host share goes; other pages are all blocks outside chrome that the host doesn't repeat.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.arrays import pair, slices
from answerloom.session import ship, stage, unstage

#: Tokens of a repeated substring (a power of two), with one mark at each end of a block.
WINDOW = 8
#: Pages of a host that must share a substring: this many, and this share of the host's pages.
MIN_PAGES, MIN_SHARE = 2, 0.1
#: Articles of a host that must share a substring for it to be no text of theirs: this share of them, and this many.
ARTICLE_SHARE, MIN_ARTICLES = 0.5, 10
#: Share of the articles in a part of the pages from which the part tells of a substring.
PART_SHARE = ARTICLE_SHARE / 2
#: Substrings of articles in a part, pages of a host that a part should have for its share to tell, and pages of it that
#: are brought together where parts have fewer.
PART, PART_PAGES, GROUP_PAGES = 1 << 22, 8, 256
#: A block goes if repeated substrings cover more than this share of its tokens.
COVERED = 0.5

# Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("head noscript template svg math object audio video canvas select button datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr "
    "ul caption colgroup".split()
)
CHROME_ELEMENTS = frozenset("nav aside footer form dialog menu search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of a class or id that tell chrome; `header` only outside an article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs masthead topbar header footer sidebar cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup "
    "login popup modal overlay share sharing social related recommended recommendations comment comments disqus replies respond pagination "
    "pager toolbar widget widgets search skip".split()
)
NEGATING = frozenset("has with no not without".split())
#: Start tags that end an open element of their kind, and what that search doesn't cross.
_ENDED_BY = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table select".split())

_TAG = re.compile(
    r"<(?:(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|!--.*?(?:-->|\Z)|[!?/][^>]*+(?:>|\Z)|[A-Za-z][^>]*+\Z)", re.S
)
_CLOSING = {name: re.compile(f"</{name}(?![\\w-])[^>]*>?", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NONE, _ARTICLE, _MAIN, _CHROME, _SKIP = range(5)

DECLARED, OPEN, CHROME = range(3)


def _role(name: str, attributes: str, in_content: bool) -> int:
    """What an element declares its text to be."""
    if name in HIDDEN:
        return _SKIP
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    if "hidden" in found or "style" in found and re.search(r"display\s*:\s*none", found["style"]):
        return _SKIP
    if name in CHROME_ELEMENTS or (name == "header" and not in_content):
        return _CHROME
    roles = found.get("role", "").lower().split()
    if CHROME_ROLES.intersection(roles):
        return _CHROME
    if name not in ("html", "body", "main") and ("class" in found or "id" in found):
        for token in f"{found.get('class', '')} {found.get('id', '')}".split():
            words = {w.lower() for w in _WORD.findall(token)}
            told = words & CHROME_WORDS
            if told and not words & NEGATING and not (in_content and told == {"header"}):
                return _CHROME
    if name == "article" or "article" in roles or found.get("itemprop", "").lower() == "articlebody":
        return _ARTICLE
    return _MAIN if name == "main" or "main" in roles else _NONE


def page_blocks(html: str) -> list[tuple[int, str]]:
    """Blocks of a page in order: (DECLARED, OPEN or CHROME, text), references decoded and white space made one space.

    Declared are the blocks of articles, or of the main part where a page has no article.
    """
    blocks: list[tuple[int, int, str]] = []  # in an article, in the main part, text
    stack: list[tuple[str, int]] = []
    depth = [0, 0, 0, 0, 0]
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                kind = _CHROME if depth[_CHROME] else _ARTICLE if depth[_ARTICLE] else _MAIN if depth[_MAIN] else _NONE
                blocks.append((kind, text))

    def close(at: int) -> None:
        for _, role in stack[at:]:
            depth[role] -= 1
        del stack[at:]

    at, end = 0, len(html)
    while at < end:
        tag = _TAG.search(html, at)
        text = html[at : tag.start() if tag else end]
        if text and not depth[_SKIP]:
            parts.append(unescape(text) if "&" in text else text)
        if not tag:
            break
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name = name.lower()
        if tag[1]:
            if name in BLOCKS or name in HIDDEN:
                if name in BLOCKS:
                    flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
            elif name == "br":
                parts.append(" ")
            continue
        if name in RAW:
            closing = _CLOSING[name].search(html, at)
            at = closing.end() if closing else end
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS or name in HIDDEN:
            if name in BLOCKS:
                flush()
                if stack and stack[-1][0] == "p":
                    close(len(stack) - 1)
                if name in _ENDED_BY:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in _ENDED_BY[name]:
                            close(i)
                            break
                        if stack[i][0] in _SCOPES:
                            break
                if name == "body" and depth[_SKIP]:  # a head that wasn't closed
                    close(next(i for i, (_, role) in enumerate(stack) if role == _SKIP))
            if name not in VOID:
                role = _role(name, tag[3], bool(depth[_ARTICLE] or depth[_MAIN]))
                depth[role] += 1
                stack.append((name, role))
    flush()
    kinds = {kind for kind, _ in blocks}
    declared = _ARTICLE if _ARTICLE in kinds else _MAIN if _MAIN in kinds else None
    tell = lambda kind: CHROME if kind == _CHROME else DECLARED if kind == declared else OPEN
    return [(tell(kind), text) for kind, text in blocks]


def is_open(blocks: list[tuple[int, str]]) -> bool:
    """Whether the markup leaves open what the main text is."""
    return all(kind != DECLARED for kind, _ in blocks) and any(kind == OPEN for kind, _ in blocks)


class Names:
    """64-bit names of tokens; 0 marks the ends of blocks."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, token: str) -> int:
        if token not in self.known:
            self.known[token] = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return self.known[token]

    def stream(self, blocks: list[tuple[int, str]], declared: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Names of the tokens of the undeclared (or declared) blocks between marks, and the block of each (-1: a mark)."""
        names, owner = [0], [-1]
        for i, (kind, text) in enumerate(blocks):
            if (kind == DECLARED) == declared:
                tokens = text.split()
                names += [*map(self.of, tokens), 0]
                owner += [*[i] * len(tokens), -1]
        return np.array(names, dtype=np.uint64), np.array(owner)


def window_suffixes(names: np.ndarray) -> np.ndarray:
    """Name of each substring of WINDOW tokens, by its start."""
    own, width = names, 1
    while width < WINDOW:
        if len(own) <= width:
            return own[:0]
        own, width = pair(own[:-width], own[width:]), 2 * width
    return own


def suffix_names(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, start and length of each substring of WINDOW tokens, and of each whole block that is shorter with its marks."""
    own = window_suffixes(names)
    marks = np.flatnonzero(owner < 0)
    short = np.flatnonzero(np.diff(marks) < WINDOW - 1)
    size = marks[short + 1] - marks[short] + 1
    block = size.astype(np.uint64)
    for j in range(WINDOW - 1):
        inside = j < size
        block = np.where(inside, pair(block, names[np.minimum(marks[short] + j, len(names) - 1)]), block)
    starts = np.concatenate([np.arange(len(own)), marks[short]])
    return np.concatenate([own, block]), starts, np.concatenate([np.full(len(own), WINDOW), size])


def _covered(owner: np.ndarray, start: np.ndarray, size: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each block, and how many of them the substrings cover."""
    inside = np.zeros(len(owner) + 1, dtype=np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, start + size, -1)
    covered = np.cumsum(inside[:-1]) > 0
    tokens = owner >= 0
    return np.bincount(owner[tokens], minlength=n_blocks), np.bincount(owner[tokens & covered], minlength=n_blocks)


def article_text(blocks: list[tuple[int, str]], shared: np.ndarray | None, names: Names | None = None) -> str:
    """The declared blocks that the substrings which the host's articles share don't cover."""
    stay = [i for i, (kind, _) in enumerate(blocks) if kind == DECLARED]
    if stay and shared is not None and len(shared):
        stream, owner = names.stream(blocks, declared=True)
        start = np.flatnonzero(np.isin(window_suffixes(stream), shared))
        if len(start):
            tokens, covered = _covered(owner, start, np.full(len(start), WINDOW), len(blocks))
            goes = covered > COVERED * tokens
            if 2 * tokens[goes].sum() <= tokens.sum():  # otherwise it is a version of other articles
                stay = [i for i in stay if not goes[i]]
    return "\n".join(blocks[i][1] for i in stay)


def kept_text(blocks: list[tuple[int, str]], repeated: np.ndarray | None, names: Names | None = None) -> str:
    """The main text: declared blocks, or the open ones that the repeated substrings of the host don't cover."""
    if not is_open(blocks):
        return article_text(blocks, None)
    stay = [i for i, (kind, _) in enumerate(blocks) if kind == OPEN]
    if repeated is not None and len(repeated):
        stream, owner = names.stream(blocks)
        found, start, size = suffix_names(stream, owner)
        hit = np.isin(found, repeated)
        tokens, covered = _covered(owner, start[hit], size[hit], len(blocks))
        unique = [i for i in stay if covered[i] / max(tokens[i], 1) <= COVERED]
        stay = unique or stay  # where nothing is the page's own, it is a copy of another page
    return "\n".join(blocks[i][1] for i in stay)


def _hosted(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))


_COUNTS = "host string, declared boolean, name long, n long, n_open long, surplus long"


def _counts(host: str, declared: bool, name: np.ndarray, n: np.ndarray, surplus: np.ndarray, whole: tuple[int, int, int]) -> pa.RecordBatch:
    """Rows of the substrings of a host, and the one without name that holds `whole`."""
    size = len(name) + 1
    return pa.record_batch(
        [
            pa.array([host] * size, pa.string()),
            pa.array([declared] * size, pa.bool_()),
            pa.array([None, *name.view(np.int64).tolist()], pa.int64()),
            pa.array([whole[0], *n.tolist()], pa.int64()),
            pa.array([whole[1]] + [0] * len(name), pa.int64()),
            pa.array([whole[2], *surplus.tolist()], pa.int64()),
        ],
        names=["host", "declared", "name", "n", "n_open", "surplus"],
    )


class Articles:
    """Substrings of the articles of each host in a part of the pages."""

    def __init__(self):
        self.each: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def add(self, host: str, blocks: list[tuple[int, str]], names: Names) -> None:
        if any(kind == DECLARED for kind, _ in blocks):
            own = np.unique(window_suffixes(names.stream(blocks, declared=True)[0]))
            self.each.setdefault(host, []).append(own)
            self.held += len(own)

    def told(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """Once `least` are held: those that PART_SHARE of the articles of a host in the part have. `surplus` is by how
        much each exceeds what the part may leave untold, and in the row without name this itself."""
        if self.held < least:
            return
        for host, each in self.each.items():
            untold = math.ceil(PART_SHARE * len(each)) - 1
            name, n = np.unique(np.concatenate(each), return_counts=True)
            name, n = name[n > untold], n[n > untold]
            yield _counts(host, True, name, n, n - untold, (len(each), 0, untold))
        self.__init__()


def _article_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Substrings of articles alone."""
    articles = Articles()
    for batch in slices(batches, "html"):
        names = Names()
        for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            articles.add(host, page_blocks(html or ""), names)
        yield from articles.told(PART)
    yield from articles.told()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Substrings outside declared text of a slice's pages with the number of pages that have each, and per host (name
    null) its pages and how many of them are open; and those of the articles of hosts that are judged here."""
    articles = Articles()
    for batch in slices(batches, "html"):
        names = Names()
        found: dict[str, list[np.ndarray]] = {}
        n_open: dict[str, int] = {}
        for host, html, here in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blocks = page_blocks(html or "")
            found.setdefault(host, []).append(np.unique(suffix_names(*names.stream(blocks))[0]))
            n_open[host] = n_open.get(host, 0) + is_open(blocks)
            if here:
                articles.add(host, blocks, names)
        for host, each in found.items():
            name, n = np.unique(np.concatenate(each), return_counts=True)
            yield _counts(host, False, name, n, 0 * n, (len(each), n_open[host], 0))
        yield from articles.told(PART)
    yield from articles.told()


def host_substrings(pages: DataFrame) -> DataFrame:
    """Substrings that MIN_PAGES pages of a host share outside declared text, those of its articles that may be shared by
    most, and two rows without name for each host: host, declared, name, n, n_open, surplus.

    `pages` has the columns id, url, host, html. Each task adds up its slices first, so a substring that all pages of a
    host with a third of all pages share is one row for each slice. Substrings of articles are told by the parts in which
    PART_SHARE of the host's articles have them, so n is a lower bound there; the surplus together with that of the row
    without name is an upper one. Hosts of fewer than MIN_ARTICLES pages tell none of them; those of less than
    PART_PAGES pages a partition, where each part would tell all it has, are brought together first, in groups of about
    GROUP_PAGES pages.
    """
    spread = pages.select("host", F.spark_partition_id().alias("part")).groupBy("host", "part").agg(F.count("*").alias("pages"))
    sizes = spread.groupBy("host").agg(F.sum("pages").alias("pages"), (F.sum("pages") >= PART_PAGES * F.count("*")).alias("here"))
    sizes = stage(sizes.where(F.col("pages") >= MIN_ARTICLES).select("host", "here", F.ceil(F.col("pages") / GROUP_PAGES).alias("groups")))
    rows = pages.join(sizes, "host", "left").select("host", "html", "here").mapInArrow(_windows, _COUNTS)
    if sizes.where("not here").limit(1).count():
        group = F.pmod(F.xxhash64("id", "url", "html"), F.col("groups"))
        thin = pages.join(sizes.where("not here"), "host").select("host", "html", group.alias("group")).repartition("host", "group").drop("group")
        rows = rows.unionByName(thin.mapInArrow(_article_windows, _COUNTS))
    total = rows.groupBy("host", "declared", "name").agg(*(F.sum(c).alias(c) for c in ("n", "n_open", "surplus")))
    out = stage(total.where(F.col("declared") | F.col("name").isNull() | (F.col("n") >= MIN_PAGES)))
    unstage(sizes)
    return out


def host_repeats(counts: DataFrame) -> DataFrame:
    """Repeated substrings of each host that has open pages, by `host_substrings`: host, names.

    A host has at most 1 / MIN_SHARE times the mean number of substrings of its pages of them (or, below
    MIN_PAGES / MIN_SHARE pages, those of these), so a row is bounded by pages, not by the host's size.
    """
    sizes = counts.where("not declared and name is null and n_open > 0").select("host", F.col("n").alias("pages"))
    shared = counts.where("not declared and name is not null").join(sizes, "host").where(F.col("n") >= MIN_SHARE * F.col("pages"))
    return shared.groupBy("host").agg(F.collect_list("name").alias("names"))


def _recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of articles that have each of the names given with their host."""
    for batch in slices(batches, "html"):
        names, given = Names(), {}
        found: dict[str, list[np.ndarray]] = {}
        for host, html, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if host not in given:
                given[host] = np.array(wanted, dtype=np.int64).view(np.uint64)
            own = np.unique(window_suffixes(names.stream(page_blocks(html or ""), declared=True)[0]))
            found.setdefault(host, []).append(own[np.isin(own, given[host])])
        for host, each in found.items():
            name, n = np.unique(np.concatenate(each), return_counts=True)
            yield pa.record_batch([pa.array([host] * len(name), pa.string()), pa.array(name.view(np.int64)), pa.array(n, pa.int64())], names=["host", "name", "n"])


def article_repeats(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """Substrings that MIN_ARTICLES and ARTICLE_SHARE of the articles of a host share, by `host_substrings`: host, shared.

    Where the bounds of a substring leave this open, the articles of its host are read again. Such a substring is in a
    PART_SHARE of them at least, so a host has at most 1 / PART_SHARE times the mean number of substrings of its articles.
    """
    limits = counts.where("declared and name is null").select(
        "host", F.greatest(F.lit(float(MIN_ARTICLES)), ARTICLE_SHARE * F.col("n")).alias("least"), F.col("surplus").alias("untold")
    )
    near = stage(counts.where("declared and name is not null").join(limits, "host").where("surplus + untold >= least").select("host", "name", "n", "least"))
    shared = near.where("n >= least").select("host", "name")
    doubtful = stage(near.where("n < least").groupBy("host").agg(F.collect_list("name").alias("names")))
    if doubtful.limit(1).count():
        again = pages.join(doubtful, "host").select("host", "html", "names").mapInArrow(_recounted, "host string, name long, n long")
        total = again.groupBy("host", "name").agg(F.sum("n").alias("n")).join(limits, "host")
        shared = shared.unionByName(total.where("n >= least").select("host", "name"))
    out = stage(shared.groupBy("host").agg(F.collect_list("name").alias("shared")))
    unstage(near, doubtful)
    return out


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: id, url, text, n_chars.

    A block is the text between block elements; references are decoded, white space (br included) becomes one space,
    blocks are joined by one line feed in page order. Text of scripts, styles, forms' controls and hidden elements is
    none. Chrome is told by elements, roles and words of classes and ids. The text has the blocks of articles (or of the
    main part) that aren't chrome, but those of whose tokens more than half are covered by substrings of WINDOW tokens that
    MIN_ARTICLES and ARTICLE_SHARE of the articles of its host share: notices that the markup doesn't tell. If these are
    more than half of an article, it is a version of other ones and all of it stays. Passages that fewer articles share
    and short blocks (headings of sections) belong to the articles.

    A page that declares neither is open: of its blocks outside chrome those go of whose tokens more than half are
    covered by substrings of WINDOW tokens (or whole short blocks) that MIN_PAGES and MIN_SHARE of the pages of its host
    share outside declared text. If all would go, the page is a copy of another one and all stay.

    Pages are parsed where they lie. What is shuffled is the substrings outside declared text, added up per task, those
    of articles that are frequent in a part of the pages, the pages of hosts that have few in each partition, and the
    open pages, which meet the repeats of their host (the adaptive join splits hosts with many pages). Articles meet theirs by a broadcast where these are few.

    Nulls: null html is empty, null ids and urls stay null; pages without a url are one host. Empty pages have an empty
    text. Repeated rows give equal rows, and count as pages each. Extra columns are ignored. An empty table gives an
    empty result. Pages are read whole.
    """
    ship(pages.sparkSession)
    rows = _hosted(pages, id_col, url_col, html_col)

    def declared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            names, repeats = Names(), {}
            texts = []
            for host, html, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if host not in repeats:
                    repeats[host] = np.array(own or [], dtype=np.int64).view(np.uint64)
                blocks = page_blocks(html or "")
                texts.append(None if is_open(blocks) else article_text(blocks, repeats[host], names))
            yield pa.record_batch([*batch.columns[:2], pa.array(texts, pa.string())], names=["id", "url", "text"]).filter(
                pa.array([t is not None for t in texts], pa.bool_())
            )

    def open_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            yield batch.filter(pa.array([is_open(page_blocks(html or "")) for html in batch.column(3).to_pylist()], pa.bool_()))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            names, repeats = Names(), {}
            texts = []
            for host, html, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if host not in repeats:
                    repeats[host] = np.array(own or [], dtype=np.int64).view(np.uint64)
                texts.append(kept_text(page_blocks(html or ""), repeats[host], names))
            yield pa.record_batch([*batch.columns[:2], pa.array(texts, pa.string())], names=["id", "url", "text"])

    schema = "id long, url string, text string"
    counts = host_substrings(rows)
    shared = article_repeats(rows, counts)
    texts = rows.join(shared, "host", "left").select("id", "url", "host", "html", "shared").mapInArrow(declared, schema)
    if counts.where("n_open > 0").limit(1).count():
        repeats = stage(host_repeats(counts))
        left = rows.mapInArrow(open_pages, rows.schema).join(repeats, "host", "left").select("id", "url", "host", "html", "names")
        texts = texts.unionByName(left.mapInArrow(judged, schema))
    unstage(counts)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
