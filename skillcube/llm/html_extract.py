"""Main-text extraction by consensus host paths.

Every page is parsed and its containers are scored: the share of the page's running text (blocks of some length that are not mostly links) that a container holds, less its links,
with a little for depth and for names that say content. The page votes for its best container's generalised path (tags and classes from the
root, digits dropped). The best container is widened first until it holds all running text of the page, its article and the headings before
it. Votes are counted per host and path in Spark; each host's winning path then extracts all its pages, so one
odd page follows its host; a page whose own choice lies on the path keeps its widened container too. A page without an element on that path, or with
less than LEAST_SHARE of its own choice's text there, falls back to its own best container, unless the host knows that container as one that its pages hold
and do not choose (a box of links or teasers): a page with a brief article then follows its host all the same.

Inside the chosen elements, subtrees of boilerplate tags or names (menus, headers, footers, sidebars, notices, adverts, forms, comments)
are left out, block elements part the text, white space inside a block (line breaks too) becomes one space, and empty blocks vanish.
A name says boilerplate if one of its classes is such a word or a compound of such words and of words of place or shape ("site-header", "nav-list-2").
A class that only holds such a word beside others ("social-science", "skip-intro") is a hint: its subtree goes only if it has no running text
or if most of its text is linked. Comments, adverts and cookie notices are named by any of their words. A header that stands in an article
and holds a heading that is no link is the article's own title and stays; one that holds none goes.

Nulls: a null html is an empty page with an empty text; pages with a null url share the host "". Broken markup never fails: unclosed
elements end with their parents, stray end tags are ignored. Parsing takes linear time whatever the markup, and memory in proportion to the page: a page is
parsed whole, on its own, so a very long one needs a worker that can hold it some ten times. Rows with equal page_id stay separate; extra columns are ignored. Ties between
paths go to more score, then to the smaller path.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm.common import read_table, slices, staged

STEP_BYTES = 1 << 21
#: Characters from which a block counts as running text.
RUNNING = 40
#: The text on a host's path counts only if it has this share of the characters of the page's own choice.
LEAST_SHARE = 0.3
#: A container is known to lose if more pages of its host pass it over than choose it, and at least one page in so many passes it over.
ONE_IN = 10

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article body center div main section td".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROPPED_TAGS = frozenset("head nav header footer aside form script style noscript template iframe textarea title button select option svg math canvas object dialog menu xmp noembed noframes audio video".split())
_DROPPED_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent notice notices alert gdpr popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist reply replies respond disqus breadcrumb breadcrumbs pagination pager toolbar widget search form skip".split()
)
#: Words that say boilerplate wherever they stand in a class.
_SURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies gdpr newsletter comment comments commentlist disqus breadcrumb breadcrumbs navbar menubar sidebar pager pagination popup".split())
#: Words of place, shape and number that make a compound with a dropped word without changing what it names.
_PLACE_WORDS = frozenset(
    "site page global main top bottom left right upper lower inner outer primary secondary sub mini mobile desktop fixed sticky bar box block area section wrapper wrap container holder panel region row col column grid list item items link "
    "links button buttons btn icon icons bg tabs tab wide full small large posts articles stories the to my".split()
)
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CONTENT_WORDS = frozenset("article content post entry main story body text".split())
#: An open element of the first set is closed by the start of one of the second.
_CLOSES = {
    "p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
_CLOSED_BY = {tag: frozenset(k for k, by in _CLOSES.items() if tag in by) for tag in _BLOCK}
_SPECIAL = re.compile("[\"'>]")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form td th button".split())


class Page:
    """Elements of a page in order, with the text that stands directly in each block."""

    def __init__(self, source: str) -> None:
        self.tag: list[str] = ["#root"]
        self.name: list[str] = [""]
        self.parent: list[int] = [-1]
        self.dropped: list[bool] = [False]
        self.content: list[bool] = [False]
        self.link: list[bool] = [False]
        #: Whether an element stands in an article or main element.
        self.own: list[bool] = [False]
        #: Elements that are kept or dropped by what they hold, whether only a heading keeps them, and whether a heading does.
        self.hinted: list[tuple[int, bool, bool]] = []
        #: (element, its nearest block, text) in page order; a block's start or end parts texts.
        self.texts: list[tuple[int, int, str]] = []
        self._parse(source)
        self._judge_hints()

    def _parse(self, source: str) -> None:
        stack, at, mark = [0], 0, 0
        opened: Counter[str] = Counter()  # of the tags on the stack
        scopes: list[tuple[int, Counter[str]]] = [(0, Counter())]  # place on the stack of each scope, and the tags since
        last = source.rfind(">")
        ends: _TagEnds | None = None

        def push(i: int) -> None:
            stack.append(i)
            opened[self.tag[i]] += 1
            if self.tag[i] in _SCOPE:
                scopes.append((len(stack) - 1, Counter()))
            else:
                scopes[-1][1][self.tag[i]] += 1

        def pop(i: int) -> None:
            while len(stack) > i:
                tag = self.tag[stack.pop()]
                opened[tag] -= 1
                if scopes[-1][0] == len(stack):
                    scopes.pop()
                else:
                    scopes[-1][1][tag] -= 1

        def open_in_scope(tags) -> bool:
            """Whether one of the tags is open in the innermost scope or opens it; a search for it then ends with a pop."""
            at, since = scopes[-1]
            return self.tag[stack[at]] in tags or any(since[t] > 0 for t in tags)

        while at < len(source):
            if at > last and not source.startswith(("<!--", "<![CDATA["), at):  # no tag ends behind here
                k = source.find("<!--", at)
                text = source[at:] if k < 0 else source[at:k]
                self.texts.append((stack[-1], mark, html.unescape(text)))
                at += len(text)
                continue
            m = _TOKEN.match(source, at) if ends is None or not _TAG.match(source, at) else None
            if m is None or m[5] == "<" and ends is None and _TAG.match(source, at):
                # a tag whose quotes never close sends the pattern to the page's end: from here on tag ends are looked up
                ends = ends or _TagEnds(source)
                m = _TAG.match(source, at)
                z = ends.find(m.end())
                cdata, (end, tag), attributes, text = None, m.groups(), source[m.end() : max(z, 0)], None if z >= 0 else "<"
                at = z + 1 if z >= 0 else at + 1
            else:
                at = m.end()
                cdata, end, tag, attributes, text = m.groups()
            if text is not None or cdata is not None:
                self.texts.append((stack[-1], mark, html.unescape(text) if text is not None else cdata))
                continue
            if tag is None:
                continue
            tag = tag.lower()
            if end:
                if tag in _BLOCK:
                    mark += 1
                if opened[tag] > 0 if tag in _BLOCK else open_in_scope((tag,)):
                    i = len(stack) - 1
                    while self.tag[stack[i]] != tag:
                        i -= 1
                    pop(i)
                continue
            if tag == "br":
                self.texts.append((stack[-1], mark, " "))
                continue
            if tag in _BLOCK:
                mark += 1
                while open_in_scope(_CLOSED_BY[tag]):
                    i = len(stack) - 1
                    while self.tag[stack[i]] not in _CLOSED_BY[tag]:
                        i -= 1
                    open_ = self.tag[stack[i]]
                    pop(i)
                    if open_ in ("p", "dt", "dd", "li"):
                        break
            if tag in _VOID:
                continue
            self._open(tag, attributes, stack[-1])
            if tag in _RAW:  # its content is no markup
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
            elif not attributes.endswith("/") or tag in _BLOCK:
                push(len(self.tag) - 1)

    def _open(self, tag: str, attributes: str, parent: int) -> None:
        a = {k.lower(): html.unescape(x or y or z) for k, x, y, z in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        names = f"{a.get('class', '')} {a.get('id', '')}".lower()
        words = set(re.split(r"[^a-z]+", names))
        style = a.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in a or "display:none" in style
        hints = words & _DROPPED_WORDS if tag not in ("html", "body", "article", "main") else set()
        title = self.own[parent] and (tag == "header" or hints == {"header"})
        drop = hidden or a.get("role", "").lower() in _DROPPED_ROLES or tag in _DROPPED_TAGS and not title or bool(hints) and not (title and hints <= {"header"}) and _names_boilerplate(names)
        if not drop and (title or hints):
            self.hinted.append((len(self.tag), title, hints <= {"header"}))
        self.own.append(self.own[parent] or tag in ("article", "main"))
        self.tag.append(tag)
        self.name.append(tag + "".join(f".{c}" for c in sorted({re.sub(r"[\d>]+", "", c) for c in a.get("class", "").lower().split()} - {""})))
        self.parent.append(parent)
        self.dropped.append(self.dropped[parent] or drop)
        self.content.append(tag in ("article", "main") or a.get("role", "").lower() in ("main", "article") or a.get("itemprop", "").lower() == "articlebody" or bool(words & _CONTENT_WORDS))
        self.link.append(self.link[parent] or tag == "a")

    def _judge_hints(self) -> None:
        """Drop hinted elements that hold neither running text nor, for headers, an unlinked heading, and those whose text is mostly linked."""
        if not self.hinted:
            return
        n = len(self.tag)
        text, linked, running, heading = [0] * n, [0] * n, [0] * n, [0] * n
        blocks: Counter[tuple[int, bool]] = Counter()
        sizes = [len("".join(t.split())) for _, _, t in self.texts]
        for (i, mark, _), size in zip(self.texts, sizes, strict=True):
            blocks[mark, self.link[i]] += size
        title = [False] * n
        for i in range(1, n):
            title[i] = self.tag[i] in _HEADINGS or title[self.parent[i]]
        for (i, mark, _), size in zip(self.texts, sizes, strict=True):
            if size and not self.dropped[i]:
                text[i] += size
                linked[i] += size * self.link[i]
                running[i] += size * (blocks[mark, False] >= RUNNING and blocks[mark, False] >= blocks[mark, True])
                heading[i] += size * (title[i] and not self.link[i])
        for i in range(n - 1, 0, -1):
            for sums in (text, linked, running, heading):
                sums[self.parent[i]] += sums[i]
        for i, title_only, as_title in self.hinted:
            kept = as_title and heading[i] or not title_only and running[i]
            self.dropped[i] |= not kept or 2 * linked[i] > text[i]
        for i in range(self.hinted[0][0], n):  # what stands in a dropped element goes with it
            self.dropped[i] |= self.dropped[self.parent[i]]

    def path(self, i: int) -> str:
        names = []
        while i > 0:
            names.append(self.name[i])
            i = self.parent[i]
        return ">".join(reversed(names))

    def keys(self) -> list[int]:
        """A 64-bit key of every element's path; equal paths have equal keys."""
        keys = [0]
        for i in range(1, len(self.tag)):
            keys.append(xxhash.xxh64_intdigest(self.name[i], keys[self.parent[i]]))
        return keys

    def passed_over(self, chosen: int) -> set[int]:
        """Containers with text that neither hold the chosen element nor stand in it."""
        n = len(self.tag)
        beside, full = [True] * n, [False] * n
        k = chosen
        while k >= 0:
            beside[k] = False
            k = self.parent[k]
        inside = [False] * n
        for i in range(1, n):
            inside[i] = i == chosen or inside[self.parent[i]]
        for i, _, t in self.texts:
            full[i] = full[i] or not t.isspace() and t != "" and not self.dropped[i]
        for i in range(n - 1, 0, -1):
            full[self.parent[i]] |= full[i]
        return {i for i in range(1, n) if self.tag[i] in _CONTAINER and beside[i] and full[i] and not inside[i] and not self.dropped[i]}

    def on_path(self, names: list[str]) -> set[int]:
        """The elements whose path has these names and that are not dropped."""
        met = [0] + [-1] * (len(self.tag) - 1)  # names that an element's path has met, -1 where it strays
        for i in range(1, len(self.tag)):
            k = met[self.parent[i]]
            met[i] = k + 1 if 0 <= k < len(names) and self.name[i] == names[k] else -1
        return {i for i in range(1, len(met)) if met[i] == len(names) and not self.dropped[i]}

    def best(self) -> tuple[int, float]:
        """The best container, widened, and its score; (0, 0.0) if the page has no running text."""
        return self.choice()[1:]

    def choice(self) -> tuple[int, int, float]:
        """The best container as scored, the same widened, and its score."""
        n = len(self.tag)
        text, linked, running = [0] * n, [0] * n, [0] * n
        blocks: dict[int, list[int]] = {}  # size and linked size of each block
        parts = []
        for i, mark, t in self.texts:
            if not self.dropped[i]:
                size = len("".join(t.split()))
                parts.append((i, mark, size))
                text[i] += size
                linked[i] += size * self.link[i]
                block = blocks.setdefault(mark, [0, 0])
                block[0] += size
                block[1] += size * self.link[i]
        long = {m for m, (size, link) in blocks.items() if size >= RUNNING and 2 * link <= size} or set(blocks)
        for i, mark, size in parts:
            running[i] += size * (mark in long)
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + 1
        for i in range(n - 1, 0, -1):
            for sums in (text, linked, running):
                sums[self.parent[i]] += sums[i]
        best = (0, 0.0)
        for i in range(1, n):
            if self.tag[i] in _CONTAINER and not self.dropped[i] and text[i]:
                share = running[i] / max(1, running[0])
                score = share * (1 - linked[i] / text[i]) + (0.02 * min(depth[i], 10) + 0.25 * self.content[i]) * (share >= 0.3)
                if score > best[1]:
                    best = (i, score)
        return best[0], self._widened(best[0], running, {m: 2 * link > size for m, (size, link) in blocks.items() if size}), best[1]

    def _widened(self, i: int, running: list[int], links: dict[int, bool]) -> int:
        """The smallest element around i with all running text, its article or main, and the heading that its text follows.

        links: the blocks with text, and whether they are mostly links; such a block parts a text from a heading before it.
        """
        while running[i] < running[0]:
            i = self.parent[i]
        k = i
        while k > 0 and self.tag[k] not in ("article", "main"):
            k = self.parent[k]
        if k > 0:
            return k
        inside, heading = [False] * len(self.tag), [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            inside[k] = k == i or inside[self.parent[k]]
            heading[k] = self.tag[k] in _HEADINGS or heading[self.parent[k]]
        first = next((k for k, (e, mark, _) in enumerate(self.texts) if inside[e] and mark in links), 0)
        farthest = 0  # all that stands between it and i is in the smallest element that holds both
        for e, mark, t in reversed(self.texts[:first]):
            if self.dropped[e] or not t.strip():
                continue
            if links[mark]:
                break
            farthest = e if heading[e] else farthest
        around = {0}
        k = farthest
        while k > 0:
            around.add(k)
            k = self.parent[k]
        while farthest and i not in around:
            i = self.parent[i]
        return i

    def text_of(self, roots: set[int]) -> str:
        """Blocks of the elements below the roots, without what is dropped."""
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = i in roots or i > 0 and inside[self.parent[i]]
        blocks: list[str] = []
        at, held = -1, []
        for i, mark, t in self.texts:
            if mark != at:
                blocks.append("".join(held))
                at, held = mark, []
            if inside[i] and not self.dropped[i]:
                held.append(t)
        blocks.append("".join(held))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def _names_boilerplate(names: str) -> bool:
    """Whether a class or id among the names is a dropped word, or a compound of dropped words and words of place."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words[:1] and words[0] in ("has", "no", "with", "without"):  # says what stands beside it
            continue
        dropped = [w for w in words if w in _DROPPED_WORDS]
        if dropped and (any(w in _SURE_WORDS for w in dropped) or all(w in _DROPPED_WORDS or w in _PLACE_WORDS for w in words)):
            return True
    return False


class _TagEnds:
    """Where a tag that starts somewhere ends: at the first > outside quotes. Every quote is looked at once, whatever the starts."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.marks = [m.start() for m in _SPECIAL.finditer(source)]
        self.known: dict[int, int] = {}  # place in marks of a quote that opens -> where the tag ends, -1: nowhere
        self.after: dict[int, int] = {}  # place of a quote -> place of the next quote of its kind
        last: dict[str, int] = {}
        for i in range(len(self.marks) - 1, -1, -1):
            c = source[self.marks[i]]
            if c != ">":
                self.after[i] = last.get(c, -1)
                last[c] = i

    def find(self, at: int) -> int:
        i = bisect.bisect_left(self.marks, at)
        chain = []
        while True:
            if i < 0 or i >= len(self.marks):
                end = -1
                break
            if self.source[self.marks[i]] == ">":
                end = self.marks[i]
                break
            if i in self.known:
                end = self.known[i]
                break
            chain.append(i)
            i = self.after[i] + 1 if self.after[i] >= 0 else -1
        for i in chain:
            self.known[i] = end
        return end


def extract(source: str, path: str | None = None, losers: frozenset[int] = frozenset()) -> str:
    """The main text of a page: of the elements on a path, or of its best container; losers: keys of paths that the host passes over."""
    page = Page(source)
    roots = page.on_path(path.split(">")) if path else set()
    chosen, widened, _ = page.choice()
    k = chosen
    while k > 0 and k not in roots:
        k = page.parent[k]
    if not roots or k in roots:
        return page.text_of(roots | {widened})
    own, voted = page.text_of({widened}), page.text_of(roots)
    if voted and (len(voted) >= LEAST_SHARE * len(own) or losers and page.keys()[chosen] in losers):
        return voted
    return own


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page's vote, and one without a path for each container that it passes over."""
    for whole in batches:
        for b in slices(whole, "html", STEP_BYTES):
            rows = []
            for name, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(source)
                chosen, widened, score = page.choice()
                if widened:
                    keys = page.keys()
                    rows.append((name, _signed(keys[widened]), page.path(widened), score, 1))
                    rows += [(name, _signed(k), None, 0.0, 0) for k in {keys[i] for i in page.passed_over(chosen)}]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["host", "key", "path", "score", "vote"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, losers: each host's winning path, from one vote of every page, and the keys of paths that its pages hold and pass over.

    A host has at most ONE_IN times as many losers as its pages pass over on average.
    """
    votes = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_votes, "host string, key long, path string, score double, vote long")
    counted, _ = staged(votes.groupBy("host", "key", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score"), F.sum("vote").alias("votes")), "host-votes")
    voted = counted.where("votes > 0")
    won = voted.groupBy("host").agg(F.max(F.struct("n", "score")).alias("most"), F.sum("n").alias("pages"))
    ties = voted.join(won, "host").where((F.col("n") == F.col("most.n")) & (F.col("score") == F.col("most.score")))
    paths = ties.groupBy("host").agg(F.min("path").alias("path"))
    known = counted.groupBy("host", "key").agg(F.sum("votes").alias("votes"), F.sum(F.when(F.col("votes") == 0, F.col("n")).otherwise(0)).alias("passed")).join(won, "host")
    losers = known.where(f"passed > votes AND {ONE_IN} * passed >= pages").groupBy("host").agg(F.collect_list("key").alias("losers"))
    return paths.join(losers, "host", "left")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "html", STEP_BYTES):
            losers = [frozenset(k % (1 << 64) for k in x or ()) for x in b.column("losers").to_pylist()]
            texts = [extract(s, p, x) for s, p, x in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), losers, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page, by its host's winning path.

    The winning paths are written out first: the join then knows their size and broadcasts them only below Spark's threshold;
    beyond it, a host with a third of all pages is a skewed side that Spark can split.
    """
    paths, _ = staged(host_paths(pages).withColumnRenamed("host", "of"), "host-paths")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    joined = rows.join(paths, host(F.col("url")) == F.col("of"), "left").select("page_id", "url", "html", "path", "losers")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
