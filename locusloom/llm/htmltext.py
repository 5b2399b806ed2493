"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by their style paths: element names with class and id, from the root down; plain
containers are told apart by their place among their like. For each style node the texts that its elements hold themselves
are counted over the host's distinct pages. A text on k of m pages has the entropy log k / log m, that is 0 if it
stands on one page only and 1 if on all. A node's content redundancy is the mean entropy of the texts of its whole branch, by
their length; it counts in full where the kinds of the node's children never change, a little less the more
they vary (presentation). Importance is 1 minus redundancy.

The host's main node is the one with the most important text. Branches that repeat themselves clearly more than it go:
beyond ``RATIO`` times its redundancy and ``SLACK``, or ``FIRM`` within a marked article. So what counts
as low follows the site: where whole pages are copies nothing stands out and nothing goes. What the tree leaves is cut by the
meaning of elements (navigation, footers, forms, asides) and by classes that say nothing but furniture (``site-footer``,
``ad-slot``; not ``related-work``), and a page that marks its article keeps only that. A page that
would lose all its text to the tree keeps what markup doesn't call furniture.

Defined results: null and empty pages have an empty text; without a host all pages make one site; pages
are parsed leniently and in linear time: unknown end tags are ignored, paragraphs and list items close each other, an
unclosed comment, script or style runs to the end, a tag that no ``>`` ends is text, a quote that nothing
closes ends with its tag; elements nested deeper than ``DEPTH`` share the style of the last; pages of a host that hold
the same texts count once in its tree; repeated rows are each answered; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusloom.llm.common import cut

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
SIBLINGS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("ul ol dl table select html body article main section div".split())
#: Elements whose meaning is furniture.
FURNITURE = frozenset("nav footer aside form button select menu dialog head object audio video canvas map".split())
#: Words of class, id and role that tell furniture, if nothing but ``PLAIN`` words stands beside them.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored "
    "sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "signin paywall share sharing social comment comments disqus respond replies reply discussion related recommended "
    "recommendations recirculation widget widgets toolbar pagination pager search searchform form contentinfo "
    "complementary skip hidden disclaimer copyright".split()
)
PLAIN = frozenset(
    "area article articles bar block body bottom box button buttons col column container content entry footer global "
    "google group header icons inner item items js left link links list main outer page panel post posts primary "
    "reader readers region right row secondary section site slot stories story thread tools top unit user users wp wrap "
    "wrapper".split()
)
HEADERS = frozenset("header topbar banner".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
KEEP = frozenset("html body article main".split())
#: Containers that are told apart by their place among their like, up to ``PLACES``.
CONTAINERS = frozenset("div section ul ol table dl header blockquote center".split())
PLACES, DEPTH = 16, 64
GAMMA, RATIO, SLACK, FIRM = 0.9, 2.0, 0.05, 0.5
#: How often a page's quotes may lack their ends before they are no longer minded.
BROKEN = 16
#: Pages that a task remembers so as not to parse their copies; others are told apart by the shuffle.
TOLD = 1 << 20
#: Style paths that all tasks are given; beyond, the join with the pages shuffles.
BROADCAST_PATHS = 1_000_000
SPLIT = re.compile(r"[^a-z0-9]+")


def _says_furniture(token: str, words: frozenset[str] = WORDS) -> bool:
    """Whether a class, id or role names furniture and nothing else."""
    parts = [w for w in SPLIT.split(token) if w and not w.isdigit()]
    return any(w in words for w in parts) and all(w in words or w in WORDS or w in PLAIN for w in parts)


class Page:
    """A page's elements in document order, each with its parent, and its pieces of text."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.named, self.path, self.depth = ["#"], [-1], [""], [0], [0]
        self.tokens: list[list[str]] = [[]]
        self.hidden = [False]
        self.pieces: list[tuple[int, str | None]] = []  # None: a block ends
        self._stack = [0]
        self._where: dict[str, list[int]] = defaultdict(list)  # of each open tag, its places in the stack
        self._scopes = [0]
        self._places: dict[tuple[int, str], int] = defaultdict(int)
        self._read(source)

    def _read(self, source: str) -> None:
        at, n, lower, broken = 0, len(source), None, 0
        while at < n:
            start = source.find("<", at)
            if start < 0:
                break
            if start > at:
                self.pieces.append((self._stack[-1], source[at:start]))
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            name = NAME.match(source, start + 1)
            if name is None and source[start + 1 : start + 2] not in ("!", "?"):
                self.pieces.append((self._stack[-1], "<"))
                at = start + 1
                continue
            close = source.find(">", start)
            if close < 0:
                at = start
                break
            if name is None:
                at = close + 1
                continue
            if broken < BROKEN and (rest := REST.match(source, name.end())):
                close = rest.end() - 1
            elif broken < BROKEN:
                broken += 1
            at = close + 1
            tag = name[0].lower()
            if tag[0] == "/":
                self._end(tag[1:])
                continue
            attributes = source[name.end() : close]
            if tag == "br":
                self.pieces.append((self._stack[-1], " "))
                continue
            if tag not in INLINE:
                self.pieces.append((0, None))
                if tag in CLOSES_P:
                    self._close(("p",))
                elif tag in SIBLINGS:
                    self._close(SIBLINGS[tag])
            if tag in VOID:
                continue
            if tag in RAW:
                if not attributes.endswith("/"):
                    lower = lower or source.lower()
                    text = lower if len(lower) == n else source
                    end = text.find("</" + tag, at)
                    close = source.find(">", end) if end >= 0 else -1
                    at = n if close < 0 else close + 1
                continue
            self._element(tag, attributes)
        if at < n:
            self.pieces.append((self._stack[-1], source[at:]))

    def _pop(self) -> str:
        k = len(self._stack) - 1
        tag = self.tag[self._stack.pop()]
        self._where[tag].pop()
        if self._scopes[-1] == k:
            self._scopes.pop()
        return tag

    def _end(self, tag: str) -> None:
        if self._where[tag]:
            while self._pop() != tag:
                pass
        if tag not in INLINE:
            self.pieces.append((0, None))

    def _close(self, tags: tuple[str, ...]) -> None:
        """Close the nearest of ``tags`` that no container hides."""
        k = max((self._where[t][-1] for t in tags if self._where[t]), default=-1)
        if k > self._scopes[-1]:
            while len(self._stack) > k:
                self._pop()

    def _element(self, tag: str, attributes: str) -> None:
        tokens: list[str] = []
        hidden = False
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                name = m[1].lower()
                if name in ("class", "id", "role", "itemprop"):
                    tokens += (m[2] or m[3] or m[4] or "").lower().split()
                elif name == "hidden":
                    hidden = True
                elif name == "aria-hidden":
                    hidden |= (m[2] or m[3] or m[4] or "").lower() == "true"
                elif name == "style":
                    hidden |= "display:none" in (m[2] or m[3] or "").lower().replace(" ", "")
        up = self._stack[-1]
        depth = self.depth[up] + (tag not in INLINE)
        words = [w for t in tokens for w in SPLIT.split(t) if w and not w.isdigit()]
        named = f"{tag}.{'.'.join(words)}"
        if not words and tag in CONTAINERS:
            self._places[up, tag] += 1
            named += str(min(self._places[up, tag], PLACES))
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.parent.append(up)
        self.hidden.append(hidden)
        self.named.append(named)
        self.depth.append(depth)
        same = tag in INLINE or depth > DEPTH  # an inline element's text is its block's
        self.path.append(self.path[up] if same else xxhash.xxh64_intdigest(f"{self.path[up]}>{named}"))
        if tag in SCOPES:
            self._scopes.append(len(self._stack))
        self._where[tag].append(len(self._stack))
        self._stack.append(len(self.tag) - 1)

    def texts(self) -> dict[int, list[str]]:
        """Of each style path, the texts that its elements hold themselves, without their blocks' texts."""
        own: dict[int, list[str]] = defaultdict(list)
        block = list(range(len(self.tag)))
        for i in range(1, len(block)):
            if self.tag[i] in INLINE:
                block[i] = block[self.parent[i]]
        for node, text in self.pieces:
            if text:
                own[block[node]].append(text)
        out: dict[int, list[str]] = defaultdict(list)
        for node, pieces in own.items():
            if text := " ".join("".join(pieces).split()):
                out[self.path[node]].append(text)
        return out

    def kinds(self) -> dict[int, tuple[tuple[int, ...], int]]:
        """Of each style path, its line of paths from the root and a hash of the kinds of its elements' children."""
        children: dict[int, set[str]] = defaultdict(set)
        line: dict[int, tuple[int, ...]] = {0: ()}
        for i in range(1, len(self.tag)):
            path, up = self.path[i], self.path[self.parent[i]]
            if path != up:
                children[up].add(self.named[i])
                if path not in line:
                    line[path] = (*line[up], path)
        return {p: (x, xxhash.xxh64_intdigest("|".join(sorted(children[p])))) for p, x in line.items() if p}

    def _furniture(self, i: int, in_main: bool) -> bool:
        tag, tokens = self.tag[i], self.tokens[i]
        if self.hidden[i]:
            return True
        if tag in KEEP:
            return tag == "article" and any(_says_furniture(t) for t in tokens)
        if tag in FURNITURE or any(_says_furniture(t) for t in tokens):
            return True
        return not in_main and (tag == "header" or any(_says_furniture(t, HEADERS) for t in tokens))

    def text(self, low: frozenset[int] = frozenset(), firm: frozenset[int] = frozenset()) -> tuple[str, int, int]:
        """The main text and the blocks that importance and that names removed.

        Style paths in ``low`` go outside articles and those in ``firm`` everywhere, unless these are all of the text.
        """
        told = self._text_without(low, firm)
        return told if told[0] or not low else self._text_without(frozenset(), frozenset())

    def _text_without(self, low: frozenset[int], firm: frozenset[int]) -> tuple[str, int, int]:
        n = len(self.tag)
        main, gone, titled = [False] * n, [0] * n, [False] * n
        for i in range(1, n):
            up, tag = self.parent[i], self.tag[i]
            main[i] = main[up] or tag in MAIN or "articlebody" in self.tokens[i]
            header = main[up] and (tag == "header" or any(_says_furniture(t, HEADERS) for t in self.tokens[i]))
            titled[i] = (titled[up] or header) and tag not in HEADINGS
            if gone[up]:
                gone[i] = gone[up]
            elif tag not in KEEP and tag not in INLINE and self.path[i] in (firm if main[i] else low):
                gone[i] = 1
            elif self._furniture(i, main[up]):
                gone[i] = 2
        marked = any(m and not g for m, g in zip(main, gone, strict=True))
        blocks, block, removed = [], [], [0, 0]
        last = None
        for node, text in self.pieces:
            if text is None:
                blocks.append("".join(block))
                block, last = [], None
            elif gone[node] or titled[node] or (marked and not main[node]):
                why = 0 if gone[node] == 1 else 1
                if last != why and text.strip():
                    removed[why] += 1
                    last = why
            else:
                block.append(text)
        blocks.append("".join(block))
        # References are decoded after the text is cut, so that none can make markup.
        blocks = [" ".join(entities.unescape(b).split()) for b in blocks if b]
        return "\n".join(b for b in blocks if b), removed[0], removed[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_NODES = "path array<long>, line array<array<long>>, kind array<int>, value array<long>, n array<long>, chars array<long>"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each page whose html is new to the task, in lists.

    Kind 0 is a text of a style path, kind 1 the kinds of its elements' children.
    """
    types = {"path": pa.int64(), "line": pa.list_(pa.int64()), "kind": pa.int32(), "value": pa.int64(), "n": pa.int64(), "chars": pa.int64()}
    told: set[tuple[str, int]] = set()
    for batch in batches:
        hosts, pages, lists = [], [], {name: [] for name in types}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            key = host, xxhash.xxh64_intdigest(source or "")
            if key in told:
                continue
            if len(told) >= TOLD:
                told.clear()
            told.add(key)
            page = Page(source or "")
            lines = page.kinds()
            nodes, whole = [], 0
            for path, texts in page.texts().items():
                sizes: dict[int, list[int]] = defaultdict(lambda: [0, 0])
                for text in texts:
                    value = xxhash.xxh64_intdigest(text)
                    sizes[value][0] += 1
                    sizes[value][1] += len(text)
                    whole += value
                if path:
                    nodes += [(path, lines[path][0], 0, value, n, chars) for value, (n, chars) in sizes.items()]
            nodes += [(path, line, 1, kind, 1, 0) for path, (line, kind) in lines.items()]
            hosts.append(host)
            pages.append(_signed(whole % (1 << 64)))
            for k, name in enumerate(types):
                if name == "line":
                    lists[name].append([[_signed(x) for x in node[k]] for node in nodes])
                else:
                    lists[name].append([_signed(node[k]) for node in nodes])
        columns = [pa.array(lists[name], pa.list_(kind)) for name, kind in types.items()]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), *columns], names=["host", "page", *types])


def style_importance(pages: DataFrame) -> DataFrame:
    """(host, path, n, chars, redundancy, main, importance) of each style node.

    ``n`` counts the texts of its branch, ``chars`` their length; ``main`` is the redundancy of the host's main node.
    """
    rows = pages.select(_host().alias("host"), "html")
    told = rows.mapInArrow(_counts, f"host string, page long, {_NODES}")
    once = told.groupBy("host", "page").agg(F.first(F.arrays_zip("path", "line", "kind", "value", "n", "chars")).alias("nodes"))
    once = cut(once)
    sizes = once.groupBy("host").agg(F.count("*").alias("m"))
    nodes = once.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    values = nodes.groupBy("host", "path", "kind", "value").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.first("line").alias("line")
    )
    text = F.col("kind") == 0
    k = F.col("k").cast("double")
    own = cut(
        values.groupBy("host", "path").agg(
            F.first("line").alias("line"),
            F.coalesce(F.sum(F.when(text, F.col("n"))), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.when(text, F.col("chars"))), F.lit(0)).alias("chars"),
            F.coalesce(F.sum(F.when(text, F.col("chars") * F.log(k))), F.lit(0.0)).alias("repeated"),
            F.sum(F.when(~text, F.col("k"))).alias("pages"),
            F.sum(F.when(~text, k * F.log(k))).alias("alike"),
        )
    )
    # The kinds of children: their entropy over the pages that have the node.
    of_pages = F.log(F.col("pages").cast("double"))
    varied = F.when(F.col("pages") > 1, F.greatest(1 - F.col("alike") / (F.col("pages") * of_pages), F.lit(0.0))).otherwise(0.0)
    branch = own.select("host", F.explode("line").alias("path"), "n", "chars", "repeated").groupBy("host", "path")
    branch = branch.agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("repeated").alias("repeated")).where("chars > 0")
    # Two more texts that stand alone: of few pages little is known.
    entropy = F.when(F.col("m") > 1, F.col("repeated") / F.log(F.col("m").cast("double")) / F.col("chars") * F.col("n") / (F.col("n") + 2))
    entropy = F.coalesce(entropy, F.lit(0.0))
    leaves = own.where("chars > 0").join(sizes, "host").withColumn("r", entropy)
    best = leaves.groupBy("host").agg(F.max_by("r", F.struct(F.col("chars") * (1 - F.col("r")), "path")).alias("main"))
    out = branch.join(own.select("host", "path", varied.alias("varied")), ["host", "path"]).join(sizes, "host").join(best, "host")
    out = out.withColumn("redundancy", entropy * (1 - (1 - GAMMA) * F.col("varied")))
    return out.select("host", "path", "n", "chars", "redundancy", "main", (1 - F.col("redundancy")).alias("importance"))


def _host() -> Column:
    found = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.lower(F.nullif(found, F.lit(""))), F.lit(""))


_TEXT = "page_id long, url string, text string, n_chars long, n_low long, n_named long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: dict[tuple, frozenset] = {}

        def paths(column: list | None, sets: dict = sets) -> frozenset:
            key = tuple(column or ())
            if key not in sets:
                sets[key] = frozenset(x % (1 << 64) for x in key)
            return sets[key]

        out = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "low", "firm")), strict=True)
        for source, low, firm in rows:
            out.append(Page(source).text(paths(low), paths(firm)) if source else ("", 0, 0))
        texts, by_tree, by_name = zip(*out, strict=True) if out else ((), (), ())
        columns = [pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], by_tree, by_name))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_low", "n_named"])


def main_text(pages: DataFrame) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars, n_low, n_named.

    The last two are the numbers of blocks that the tree and that names removed.
    """
    least = RATIO * F.col("main") + SLACK
    nodes = style_importance(pages).where(F.col("redundancy") > least)
    firm = F.when(F.col("redundancy") > least + (FIRM - SLACK), F.col("path"))
    low = nodes.groupBy("host").agg(F.array_sort(F.collect_set("path")).alias("low"), F.array_sort(F.collect_set(firm)).alias("firm"))
    low = cut(low)  # of each site, its templates
    few = low.agg(F.coalesce(F.sum(F.size("low") + 1), F.lit(0))).first()[0] <= BROADCAST_PATHS
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("host"))
    rows = rows.join(F.broadcast(low) if few else low, "host", "left").select("page_id", "url", "html", "low", "firm")
    return rows.mapInArrow(_extract, _TEXT)
