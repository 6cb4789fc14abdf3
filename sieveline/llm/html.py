"""Operator 2: HTML extraction by consensus host paths.

Each page is parsed once into text blocks with the tag-class path of the container around each,
and stored. A page with an article votes for the outermost one that has most of its wanted text.
Of the pages without one, Spark gathers for each host and generalised path (digits dropped) how
many pages have it, how much text and link text it holds and how many different texts: a path
that is full of links or says the same on page after page is furniture; the smallest container
of the remaining paths that at least half the pages have is what those pages agree on. The path
that wins is the host's; the main text of its pages is what lies below it, less the furniture.
A page that has less than half of its text there, or whose article reaches beyond it, falls back on
its own container. Paths within articles are furniture if they say the same on page after page while
the articles differ. All of this holds for hosts of any number of pages.

Navigation, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles
are left out by tag, by role and by names in class and id: a name counts if it is one of the plain
ones, or if it, or the whole attribute, has no other words than such names and qualifiers; names in
camel case are cut into words. Names with other words are left to the vote.

Defined results: null, empty and text-free html give an empty text; a null url has the host "";
broken markup never fails: unclosed tags end with their container, stray end tags are ignored,
a quote that never closes ends with its tag, a tag, comment or raw element that never ends hides
the rest; containers below the 64th level count as that one; repeated rows are extracted each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, only, stored
from .urls import url_host

STOP = re.compile(r"[>\"']")
NAME = re.compile(r"[a-zA-Z][^\s>/]*")
VALUE = re.compile(r"=\s*\Z")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""", re.S)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")  # camel case is cut into its words
ARTICLE = re.compile(r"/(?:article|main)\b")
DEEPEST = 64

#: HTML's void elements; those whose content is raw; those that stand in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
SKIPPED = frozenset("head script style noscript template nav footer aside form button select option textarea iframe svg canvas object embed menu dialog video audio map title xmp noembed noframes".split())
#: Roles and words of class or id that name what is not the article.
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
#: Names that alone say so, words that say so in company of such words and qualifiers only, qualifiers.
SKIP_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies consent gdpr popup modal overlay newsletter comments commentlist disqus discussion discussions responses pagination pager toolbar".split())
SKIP_WORDS = SKIP_NAMES | frozenset("sponsor sponsored promo promotion promoted banner aside notice notices subscribe subscription signup login share sharing social comment respond reply replies related recommended recommendations widget widgets copyright disclaimer".split())
QUALIFIERS = frozenset("site page main top bottom left right inner outer box list bar block wrap wrapper container section area item items posts post links link buttons icons primary secondary global header media form alert slot unit panel row col column user users reader readers visitor visitors article content story our your latest new".split())
HEADER_WORDS = frozenset("header topbar".split())
CLOSES = {  # an opening tag ends an open one of these
    "p": frozenset(["p"]),
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul p".split())
P_ALONE, NOTHING = frozenset(["p"]), frozenset()
SCOPES = frozenset("body html div article section main td th table ul ol dl aside nav footer header form blockquote figure".split())


class Node:
    """An open element: its container's generalised path, and whether it is left out, a link, in an article."""

    __slots__ = ("tag", "path", "depth", "skip", "link", "inside")

    def __init__(self, tag: str, path: str, depth: int, skip: bool, link: bool, inside: bool):
        self.tag, self.path, self.depth, self.skip, self.link, self.inside = tag, path, depth, skip, link, inside


def generalised(tag: str, attributes: dict[str, str]) -> str:
    """Tag with the first class, digits dropped: pages of one template share it."""
    first = re.sub(r"\d+", "", ((attributes.get("class") or attributes.get("id") or "").split() or [""])[0]).strip("-_").replace("/", "-")
    if len(first) > 64:  # a path has 64 levels at most, and no level is long
        first = f"{first[:32]}-{xxhash.xxh64_hexdigest(first)}"
    return f"{tag}.{first}" if first else tag


def words_of(name: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(name)]


def names_furniture(value: str, inside: bool) -> bool:
    """Whether a class or id says that an element is no part of the article."""
    plain = words_of(value)
    if SKIP_WORDS.isdisjoint(plain) and HEADER_WORDS.isdisjoint(plain):
        return False
    if SKIP_WORDS.union(QUALIFIERS).issuperset(plain) and not SKIP_WORDS.isdisjoint(plain):
        return True
    for name in value.split():
        words = words_of(name)
        if len(words) == 1 and words[0] in SKIP_NAMES:
            return True
        if len(words) > 1 and SKIP_WORDS.union(QUALIFIERS).issuperset(words) and not SKIP_WORDS.isdisjoint(words):
            return True
        if not inside and not HEADER_WORDS.isdisjoint(words) and QUALIFIERS.union(HEADER_WORDS).issuperset(words):
            return True
    return False


def unwanted(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is no part of the article; a header is one only inside an article."""
    if tag in SKIPPED or tag == "header" and not inside:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(names_furniture(attributes.get(k) or "", inside) for k in ("class", "id"))


class Scanner:
    """The pieces of a page in order, in one pass: ("text" | "start" | "end", text or tag name, attributes)."""

    def __init__(self, html: str):
        self.html, self.at, self.missing = html, 0, set()

    def _find(self, what: str, at: int) -> int:
        """Like ``str.find``, but what is missing once is not sought again."""
        if what in self.missing:
            return -1
        if (found := self.html.find(what, at)) < 0:
            self.missing.add(what)
        return found

    def _after(self, what: str, at: int) -> int:
        found = self._find(what, at)
        return len(self.html) if found < 0 else found + len(what)

    def _tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, or -1; one within a quoted value does not."""
        while m := STOP.search(self.html, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            before = self.html[max(0, m.start() - 16) : m.start()]
            if VALUE.search(before):  # only after an equals sign does a quote begin a value
                close = self._find(m[0], at)
                at = close + 1 if close >= 0 else at
        return -1

    def skip_raw(self, tag: str) -> None:
        """Go past the end tag of a raw element."""
        close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(self.html, self.at)
        self.at = self._after(">", close.end()) if close else len(self.html)

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        html, end = self.html, len(self.html)
        while self.at < end:
            at = self.at
            if html[at] != "<":
                stop = self._find("<", at)
                self.at = end if stop < 0 else stop
                yield "text", html[at : self.at], ""
                continue
            after = html[at + 1 : at + 2]
            if html.startswith("<!--", at):
                self.at = at + 5 if html.startswith("<!-->", at) else self._after("-->", at + 4)
            elif html.startswith("<![CDATA[", at) and self._find("]]>", at) >= 0:
                self.at = self._after("]]>", at)
            elif after in ("!", "?"):
                self.at = self._after(">", at)
            elif after == "/" and (m := NAME.match(html, at + 2)):
                self.at = self._after(">", m.end())
                yield "end", m[0].lower(), ""
            elif after == "/":
                self.at = self._after(">", at)
            elif m := NAME.match(html, at + 1):
                stop = self._tag_end(m.end())
                self.at = end if stop < 0 else stop + 1
                if stop >= 0:
                    yield "start", m[0].lower(), html[m.end() : stop]
            else:
                self.at = at + 1
                yield "text", "<", ""


def blocks(html: str | None) -> list[tuple[str, str, int]]:
    """Text, path of the container and length of its link text, of each block of a page in order."""
    out: list[tuple[str, str, int]] = []
    stack = [Node("", "", 0, False, False, False)]
    places: dict[str, list[int]] = {}  # of each tag, where in the stack it is open
    scopes = [0]  # where containers are
    line: list[str] = []
    links = 0
    container = ""

    def end_block() -> None:
        nonlocal links
        if line:
            text = " ".join(unescape("".join(line)).split())
            if text:
                out.append((text, container, links))
            line.clear()
        links = 0

    def close(depth: int) -> None:
        for n in stack[depth:]:
            places[n.tag].pop()
        del stack[depth:]
        while scopes[-1] >= depth:
            scopes.pop()

    scanner = Scanner(html or "")
    for kind, tag, rest in scanner:
        top = stack[-1]
        if kind == "text":
            if not top.skip:
                line.append(tag)
                if top.link:
                    links += len(tag)
            continue
        if kind == "end":
            if not places.get(tag):
                if tag == "p":
                    end_block()
                elif tag == "br" and not top.skip:
                    line.append(" ")
                continue
            depth = places[tag][-1]
            if tag in INLINE and depth < scopes[-1]:  # an inline end tag does not end a container
                continue
            if tag not in INLINE:
                end_block()
            close(depth)
            container = stack[-1].path
            continue
        if tag == "br":
            if not top.skip:
                line.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            continue
        attributes = {}
        if rest and rest != "/":
            for k, a, b, c in ATTRIBUTE.findall(rest):
                attributes.setdefault(k.lower(), unescape(a or b or c))
        if tag not in INLINE:
            end_block()
            ends = CLOSES.get(tag) or (P_ALONE if tag in BLOCKS_CLOSE_P else NOTHING)
            last = max((places[t][-1] for t in ends if places.get(t)), default=0)
            if last and last >= scopes[-1]:  # none beyond the innermost container
                close(last)
            while len(stack) > 1 and stack[-1].tag in INLINE:  # an unclosed inline tag ends with its line
                close(len(stack) - 1)
        top = stack[-1]
        skip = top.skip or unwanted(tag, attributes, top.inside)
        if tag in RAW:
            if not rest.endswith("/"):
                scanner.skip_raw(tag)
            continue
        path, depth = top.path, top.depth
        if tag in SCOPES and depth < DEEPEST:
            path, depth = f"{path}/{generalised(tag, attributes)}", depth + 1
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(Node(tag, path, depth, skip, top.link or tag == "a", top.inside or tag in ("article", "main")))
        if tag not in INLINE:
            container = path
    end_block()
    return out


def votes(found: list[tuple[str, str, int]]) -> dict[str, int]:
    """Score of each container path of a page: its text outside links; link-heavy blocks count against it.

    A container gets the text of those below it too.
    """
    scores: dict[str, int] = {}
    for text, path, links in found:
        worth = len(text) - 3 * links
        while path:
            scores[path] = scores.get(path, 0) + worth
            path = path.rpartition("/")[0]
    return scores


def wanted(found: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The blocks that are not link-heavy, or all if none is."""
    return [b for b in found if len(b[0]) > 3 * b[2]] or found


def article_path(found: list[tuple[str, str, int]]) -> str | None:
    """The outermost article with most of a page's wanted text."""
    good = wanted(found)
    if not any(ARTICLE.search(path) for _, path, _ in good):
        return None
    scores, whole = votes(good), sum(len(t) - 3 * n for t, _, n in good)
    articles = [p for p in scores if ARTICLE.search(p) and 2 * scores[p] > whole]
    return min(articles, key=lambda p: (p.count("/"), -scores[p], p)) if articles else None


def best(found: list[tuple[str, str, int]]) -> str:
    """The page's article, else the smallest container with all wanted text: "" if no single one has it."""
    if (own := article_path(found)) is not None:
        return own
    return "/".join(os.path.commonprefix([at.split("/") for _, at, _ in wanted(found)]))


def below(found: list[tuple[str, str, int]], path: str) -> str:
    return "\n".join(text for text, at, _ in found if at == path or at.startswith(path + "/"))


def extract(html: str | None, path: str | None) -> str:
    """The main text of one page, given its host's path; the rule that ``main_text`` states in Spark."""
    found = blocks(html)
    if not found:
        return ""
    own = best(found)
    beyond = ARTICLE.search(own) and not f"{own}/".startswith(f"{path}/")
    if path and not beyond and (text := below(found, path)) and 2 * len(text) >= len(below(found, own)):
        return text
    return below(found, own)


PARSED = "page_id {}, url string, host string, print long, article string, best string, blocks array<struct<text string, path string, links int>>"


def parsed(pages: DataFrame) -> DataFrame:
    """The blocks of each page, its article if it has one, its own best container and a hash of its text; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks(h) for h in b.column(3).to_pylist()]
            flat = [x for f in found for x in f]
            texts, paths, links = zip(*flat, strict=True) if flat else ((), (), ())
            items = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(paths, pa.string()), pa.array(links, pa.int32())], names=["text", "path", "links"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), items)
            prints = [xxhash.xxh64_intdigest("\n".join([x[0] for x in f])) >> 1 for f in found]
            own = [article_path(f) for f in found]
            at = [a if a is not None else best(f) for a, f in zip(own, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(prints, pa.int64()), pa.array(own, pa.string()), pa.array(at, pa.string()), lists], names=["page_id", "url", "host", "print", "article", "best", "blocks"])

    rows = only(pages, "page_id", "url", "html").select("page_id", "url", url_host(F.col("url")).alias("host"), "html")
    return stored(rows.mapInArrow(run, PARSED.format(pages.schema["page_id"].dataType.simpleString())), "parsed", compression="zstd")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, all_blocks, texts, chars, links of the blocks (print, pos, text, links) of different pages.

    Counts are exact and pre-aggregated: pages that say the same are one, a text is counted where it first meets itself.
    """
    text = F.xxhash64("text").alias("said")
    once = rows.groupBy(*keys, "print", "pos", text, F.length("text").alias("size"), F.col("links").alias("linked")).agg(F.lit(1).alias("one"))
    texts = once.groupBy(*keys, "said").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    return texts.groupBy(*keys).agg(F.sum("n").alias("all_blocks"), F.count("*").alias("texts"), F.sum("size").alias("chars"), F.sum("linked").alias("links"))


def exploded(pages: DataFrame) -> DataFrame:
    return pages.select("host", "print", "article", F.posexplode("blocks").alias("pos", "b")).select("host", "print", "article", "pos", "b.path", "b.text", "b.links")


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, furniture, asides: the container that the parsed pages of each host agree on, the paths below it that are no text, and those within articles.

    A path is furniture if it is full of links or if its texts come up three times each on average.
    Within articles only the second counts, where less than a quarter of the articles' text is there
    and the longest blocks of the articles differ: pages that are near copies repeat those too.
    """
    has_text = pages.where(F.size("blocks") > 0)
    with_article = has_text.where("article IS NOT NULL")
    longest = F.array_max(F.transform("blocks", lambda b: F.struct(F.length(b["text"]).alias("n"), F.xxhash64(b["text"]).alias("said"))))
    sizes = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    pages_of = with_article.groupBy("host", "article", "print").agg(F.count("*").alias("n"), F.first(longest["said"]).alias("said"), F.first(sizes).alias("size"))
    articles = pages_of.groupBy("host", "article").agg(F.sum("n").alias("n")).groupBy("host").agg(F.max(F.struct("n", "article")).alias("won"), F.sum("n").alias("with_article"))
    leads = pages_of.groupBy("host", "said").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("host").agg(F.sum("n").alias("pages"), F.count("*").alias("leads"), F.sum("size").alias("whole"))
    inner = repeated(exploded(with_article).where(F.col("path").startswith(F.concat("article", F.lit("/")))), "host", "path")
    aside = inner.where("3 * texts <= all_blocks").join(leads, "host").where("2 * pages < 3 * leads AND 4 * chars < whole")
    asides = aside.groupBy("host").agg(F.collect_set("path").alias("asides"))
    plain = has_text.where("article IS NULL")
    paths = repeated(exploded(plain), "host", "path").withColumn("furniture", F.expr("chars < 3 * links OR 3 * texts <= all_blocks"))
    have = plain.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["path"]))).alias("path")).groupBy("host", "path").agg(F.count("*").alias("have"))
    counted = plain.groupBy("host").agg(F.count("*").alias("without_article"))
    judged = paths.join(have, ["host", "path"]).join(counted, "host")
    steps = F.split("path", "/")
    shared = judged.where(~F.col("furniture") & (2 * F.col("have") >= F.col("without_article"))).groupBy("host").agg(F.min(steps).alias("low"), F.max(steps).alias("high"), F.sum("chars").alias("kept"))
    # the common beginning of the smallest and of the largest is common to all
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("low"), F.size("high"))), lambda i: F.slice("low", F.lit(1), i) == F.slice("high", F.lit(1), i))
    container = F.array_join(F.slice("low", F.lit(1), F.size(F.filter(same, lambda x: x))), "/")
    agreed = shared.select("host", container.alias("container"), "kept")
    dropped = judged.where("furniture").groupBy("host").agg(F.collect_set("path").alias("furniture"), F.sum("chars").alias("dropped"))
    other = counted.join(agreed, "host", "left").join(dropped, "host", "left")
    both = articles.join(other, "host", "full").join(asides, "host", "left")
    by_article = F.coalesce("with_article", F.lit(0)) >= F.coalesce("without_article", F.lit(0))
    furniture = F.when(F.coalesce("kept", F.lit(0)) > F.col("dropped"), F.col("furniture"))  # what is most of a host's text is its text
    return both.select("host", F.when(by_article, F.col("won.article")).otherwise(F.col("container")).alias("path"), furniture.alias("furniture"), "asides")


def within(block: Column, path: Column) -> Column:
    return (block["path"] == path) | block["path"].startswith(F.concat(path, F.lit("/")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the host's path of each page."""
    bounded_batches(pages.sparkSession, 500)
    found = parsed(pages)
    # stored, so that its size is known: Catalyst broadcasts it below the session's threshold, else joins by sorting and splits hot hosts
    paths = stored(host_paths(found), "host-paths").withColumnRenamed("host", "voted")
    rows = found.join(paths, F.col("host") == F.col("voted"), "left")
    out = F.when(F.col("article").isNull(), F.col("furniture")).otherwise(F.col("asides"))
    good = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("out", b["path"]), F.lit(False)))
    rows = rows.withColumn("out", out).withColumn("blocks", F.when(F.col("out").isNotNull() & (F.size(good) > 0), good).otherwise(F.col("blocks")))
    beyond = F.col("article").isNotNull() & ~F.concat("article", F.lit("/")).startswith(F.concat("path", F.lit("/")))
    at = F.filter("blocks", lambda b: within(b, F.col("path")))
    own = F.filter("blocks", lambda b: within(b, F.col("best")))
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]) + 1)  # noqa: E731  with a line end each
    by_host = (F.coalesce("path", F.lit("")) != "") & ~beyond & (F.size(at) > 0) & (2 * (size(at) - 1) >= size(own) - 1)
    text = F.array_join(F.transform(F.when(by_host, at).otherwise(own), lambda b: b["text"]), "\n")
    return rows.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"), "path").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
