"""Main text of web pages by consensus host paths.

Every page is parsed once to score its containers; its best one votes, as a generalised path of tags and
classes, for its host. Spark counts the votes; the winning path of a host is then used to extract all
its pages again. A page that lacks the path, or has clearly less text there than in its own best container,
keeps its own.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import stored

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot semantics".split())
_SKIP_TAGS = frozenset("head nav header footer aside form script style noscript template iframe svg annotation button select option textarea menu dialog object canvas audio video map title xmp noframes".split())
_SKIP_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar side aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent notice notices gdpr comment comments disqus respond replies breadcrumb breadcrumbs share sharing social related newsletter subscribe "
    "subscription signup login popup modal overlay widget pagination pager toolbar search".split()
)
#: Words that say nothing about an element. Inside an article a name is boilerplate only if all its words are in
#: these lists, so "ad-banner" is and "ad-hoc" or "article-header" is not, and a heading may stand in a header.
_NEUTRAL = frozenset("area bar block bottom box button buttons container content group inner item items left link links list outer post posts right row section site slot top unit wrap wrapper".split())
_IN_ARTICLE = _SKIP_WORDS - {"header", "side", "social"}
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: The text at a host's path counts if it holds this share of what the page's own container holds.
HOLD = 0.9
#: Hosts whose winning paths are sent to every executor (a few MB); more are joined.
BROADCAST_HOSTS = 20_000


@dataclass
class Parsed:
    """A page's text blocks, their characters outside links, and its containers: parent, key, first block, end block.

    ``left_out`` has the place and the characters outside links of each element skipped for its class or id alone,
    ``chars`` those of the page with these elements.
    """

    blocks: list[str] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)
    nodes: list[list] = field(default_factory=list)
    left_out: list[tuple[int, int]] = field(default_factory=list)
    chars: int = 0

    def solid(self) -> list[int]:
        """Running sums of the characters outside links, over blocks that are not mostly links."""
        return [0, *accumulate(w if 2 * w > len(b) else 0 for w, b in zip(self.weights, self.blocks))]

    def path(self, i: int) -> str:
        keys = []
        while i >= 0:
            keys.append(self.nodes[i][1])
            i = self.nodes[i][0]
        return ">".join(reversed(keys))


def _boilerplate(value: str, inside: bool) -> bool:
    """Whether a class or id names boilerplate; more narrowly ``inside`` an article."""
    if _SKIP_WORDS.isdisjoint(_SPLIT.split(value)):
        return False
    if not inside:
        return True
    names = (set(_SPLIT.split(name)) for name in value.split())
    return any(n & _IN_ARTICLE and all(w in _IN_ARTICLE or w in _NEUTRAL or not w or w.isdigit() for w in n) for n in names)


def _skipped(tag: str, attrs: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element is boilerplate by its tag, role or hiding, whether by a word in its class or id, and its generalised key."""
    skip, worded, key = tag in _SKIP_TAGS and not (inside and tag == "header"), False, tag
    if not attrs or "=" not in attrs:
        return skip, False, tag
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "class":
            first = value.split()
            if first:
                key = f"{tag}.{re.sub('[0-9]+', 'N', first[0])}"
        if name in ("class", "id"):
            worded = worded or (tag not in ("html", "body", "article", "main") and _boilerplate(value, inside))
        elif name == "role":
            skip = skip or not _SKIP_ROLES.isdisjoint(value.split())
        elif name == "aria-hidden":
            skip = skip or value == "true"
    return skip or bool(re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs))), worded, key


def parse(page: str, spared: frozenset[int] = frozenset()) -> Parsed:
    """Blocks and containers of a page, in one pass over its bytes; broken markup never fails.

    Elements that start at a place in ``spared`` are not skipped for their class or id.
    """
    out = Parsed()
    pieces: list[str] = []
    stack: list[tuple[str, int, bool, bool, int, int]] = []  # tag, node or -1, skipped, skipped by more than a word, place, chars before
    open_tags: Counter[str] = Counter()
    skipping, firmly, node, at, n, quoted, linked = 0, 0, -1, 0, len(page), True, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.blocks.append(text)
                out.weights.append(max(0, len(text) - linked))
            linked = 0

    def pop() -> None:
        nonlocal skipping, firmly, node
        tag, i, skipped, firm, place, before = stack.pop()
        open_tags[tag] -= 1
        if skipped:
            skipping -= 1
            firmly -= firm
            if not firm and out.chars > before:
                out.left_out.append((place, out.chars - before))
        if i >= 0:
            flush()
            out.nodes[i][3] = len(out.blocks)
            node = out.nodes[i][0]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not firmly and not open_tags["a"]:
            out.chars += len(page[at:lt].strip())
        if lt > at and not skipping:
            pieces.append(page[at:lt])
            linked += lt - at if open_tags["a"] else 0
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        following = page[lt + 1 : lt + 2]
        if following in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) if quoted else None
        if m is None and (following == "/" or following.isalpha()) and following.isascii():
            end = page.find(">", lt)
            if end < 0:  # an unfinished tag ends the page
                break
            quoted = False  # a quote is never closed: from here on tags end at the first >
            m = re.match(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", page[lt : end + 1])
        if m is None:
            if following == "/":
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                if not skipping:
                    pieces.append("<")
                at = lt + 1
            continue
        at = lt + len(m[0])
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                flush()
            elif open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag not in _INLINE:
                flush()
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in _CLOSES_P and open_tags["p"] > 0:
            while stack[-1][0] != "p":
                pop()
            pop()
        if tag in _SAME and open_tags[tag] > 0:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in _SAME[tag]:
                    break
        firm, worded, key = _skipped(tag, m[3], open_tags["article"] + open_tags["main"] > 0)
        skip = firm or (worded and lt not in spared)
        if tag in _RAW_END:
            found = _RAW_END[tag].search(page, at)
            at = n if found is None else found.start()
        i = -1
        if tag not in _INLINE:
            flush()
            i = len(out.nodes)
            out.nodes.append([node, key, len(out.blocks), len(out.blocks)])
            node = i
        stack.append((tag, i, skip, firm, lt, out.chars))
        open_tags[tag] += 1
        skipping += skip
        firmly += firm
    while stack:
        pop()
    flush()
    return out


def whole(page: str) -> Parsed:
    """``parse``, but elements that hold most of the page's text are not skipped for a word in their class or id.

    Where an article or main element is read, and holds half of what is, such elements are no main text.
    """
    p = parse(page)
    spared = frozenset(place for place, chars in p.left_out if 2 * chars > p.chars)
    return p if not spared or _named(p) else parse(page, spared)


def _named(p: Parsed) -> list[int]:
    """The article and main elements that hold half of the text."""
    total = [0, *accumulate(p.weights)]
    return [i for i, x in enumerate(p.nodes) if x[1].split(".")[0] in ("article", "main") and 2 * (total[x[3]] - total[x[2]]) >= total[-1] > 0]


def best_container(p: Parsed) -> tuple[int, int]:
    """The container that holds the page's main text (-1: the page itself), and its characters outside links.

    The largest article or main element that holds half of the text; else, from the top, the child beside
    which its parent has nothing but links, as long as there is one.
    """
    total, solid = [0, *accumulate(p.weights)], p.solid()
    size = lambda i: total[p.nodes[i][3]] - total[p.nodes[i][2]]
    named = _named(p)
    if named:
        best = max(named, key=lambda i: (p.nodes[i][1].split(".")[0] == "article", size(i), -i))
        return best, size(best)
    at, held = -1, total[-1]
    for i, x in enumerate(p.nodes):  # in page order, so a child follows its parent
        if x[0] == at and solid[x[3]] - solid[x[2]] == solid[-1] > 0 and x[1].split(".")[0] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "pre"):
            at, held = i, size(i)
    return at, held


def blocks_at(p: Parsed, path: str) -> list[tuple[int, int]]:
    """First and end block of all containers with this path; nested ones count once."""
    leaf = path.rsplit(">", 1)[-1]
    out, end = [], 0
    for i, x in enumerate(p.nodes):
        if x[1] == leaf and x[2] >= end and p.path(i) == path:
            out.append((x[2], x[3]))
            end = max(end, x[3])
    return out


def main_text(page: str, path: str | None) -> str:
    """The text at ``path``, or in the page's own best container where that holds clearly more."""
    p = whole(page)
    solid = p.solid()
    i, _ = best_container(p)
    own = [(0, len(p.blocks)) if i < 0 else (p.nodes[i][2], p.nodes[i][3])]
    there = blocks_at(p, path) if path else []
    held = lambda ranges: sum(solid[b] - solid[a] for a, b in ranges)
    use = there if any(a < b for a, b in there) and held(there) >= HOLD * held(own) else own
    return "\n".join(t for a, b in use for t in p.blocks[a:b])


def _clean(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path that most pages of a host vote for, by characters and then name in ties."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], list[int]] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                p = whole(page.as_py())
                i, size = best_container(p)
                if i >= 0 and size:
                    v = votes.setdefault((host, p.path(i)), [0, 0])
                    v[0] += 1
                    v[1] += size
            rows = [(*k, *v) for k, v in votes.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, [pa.string(), pa.string(), pa.int64(), pa.int64()])], ["host", "path", "votes", "chars"])

    votes = _clean(pages).select("host", "html").mapInArrow(each, "host string, path string, votes long, chars long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "chars", "path")).alias("top")).select("host", "top.path")


def extracted(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Blocks are separated by block elements and line breaks, character references are decoded, white space
    in a block becomes one space, and blocks are joined by a line end. Null html is empty and has an empty
    text; a null or odd url belongs to the host "". Repeated rows get equal texts; other columns are
    not read; an empty table gives no rows. Broken markup is read as far as it goes.
    """
    spark = pages.sparkSession
    winners = stored(host_paths(pages), "paths")
    rows = _clean(pages)
    few = winners.count() <= BROADCAST_HOSTS
    sent = spark.sparkContext.broadcast({r.host: r.path for r in winners.collect()} if few else {})
    if few:
        rows = rows.withColumn("path", F.lit(None).cast("string"))
    else:
        rows = rows.join(winners.withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left").drop("of")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), sent.value.get(host) if few else path) for host, page, path in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "host", "html", "path").mapInArrow(each, "page_id long, url string, text string, n_chars long")
