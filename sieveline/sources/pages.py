"""Page sources: list pages, JSON and CSS answers, SVG fonts, and fetching by a Python data source."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow.compute
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.window import Window

LINK = r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, href, name of every link in order; names are stripped of markup and outer white space."""
    hrefs, names = F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)), F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(hrefs.alias("href"), names.alias("name"))).alias("pos", "link"))
    return rows.select(key, "pos", "link.href", F.regexp_replace(F.regexp_replace("link.name", "<[^>]*>", ""), r"^\s+|\s+$", "").alias("name"))


def absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(href, F.lit("/"))))


def list_page(pages: DataFrame, key: str, html: str, base: str, download: str, suffix: str = ".font", skipped: Sequence[str] = ("download", "donate")) -> DataFrame:
    """Entries of a list page: name, absolute url, download url by slug, and the count that the text after the link says."""
    entry = rf'(?is)<a\s[^>]*?href\s*=\s*"([^"]*\{suffix})"[^>]*>(.*?)</a>(.*?)(?=<a\s[^>]*?href\s*=\s*"[^"]*\{suffix}"|\z)'
    cols = [F.regexp_extract_all(F.col(html), F.lit(entry), F.lit(i)).alias(n) for i, n in ((1, "href"), (2, "name"), (3, "after"))]
    rows = pages.select(key, F.posexplode(F.arrays_zip(*cols)).alias("pos", "e"))
    name = F.regexp_replace(F.regexp_replace("e.name", "<[^>]*>", ""), r"^\s+|\s+$", "")
    slug = F.element_at(F.split(F.replace(F.col("e.href"), F.lit(suffix), F.lit("")), "/"), -1)
    count = F.regexp_replace(F.regexp_extract("e.after", r"(\d[\d,]*)\s+downloads", 1), ",", "")
    out = rows.select(key, "pos", name.alias("name"), absolute(F.col("e.href"), base).alias("url"), F.concat(F.lit(download), F.replace(slug, F.lit("-"), F.lit("_"))).alias("download_url"), F.coalesce(F.try_to_number(F.nullif(count, F.lit("")), F.lit("999999999999")).cast("bigint"), F.lit(0)).alias("downloads"))
    return out.where((F.col("name") != "") & ~F.lower("name").isin(list(skipped)))


def or_else(found: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """The rows of the first parser; of the second for pages where the first found none."""
    return found.unionByName(fallback.join(found.select(key).distinct(), key, "left_anti"))


def search_page(pages: DataFrame, key: str, html: str, base: str, part: str = "/font/", skipped: Sequence[str] = ("download", "preview", "share", "embed")) -> DataFrame:
    """Links below ``part`` with a name of two letters or more, the first of each url."""
    rows = links(pages, key, html).where(F.col("href").contains(part) & (F.length("name") >= 2) & ~F.lower("name").isin(list(skipped))).withColumn("url", absolute(F.col("href"), base))
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "url").orderBy("pos"))).where("_rn = 1").select(key, "pos", "name", "url", F.lit("").alias("download_url"))


def guarded_json(text: Column, schema: str) -> Column:
    """JSON behind the )]}' prefix."""
    return F.from_json(F.regexp_replace(text, r"^\)\]\}'", ""), schema)


def first_css_url(css: Column, host: str) -> Column:
    return F.regexp_extract(css, rf"url\((https://{host}/[^)]*)\)", 1)


def svg_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """file, font, unicode, d, advance of the glyphs of SVG fonts; empty outlines are skipped."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    tag = F.regexp_extract_all("value", F.lit(r"(?s)(<glyph\b[^>]*>)"), F.lit(1))
    font = F.coalesce(F.nullif(F.regexp_extract("value", r'<font\b[^>]*?\bid="([^"]*)"', 1), F.lit("")), F.regexp_extract("file", r"([^/]*)\.[^./]*$", 1))
    g = text.select("file", font.alias("font"), F.explode(tag).alias("g"))
    at = lambda name: F.regexp_extract("g", rf'\s{name}="([^"]*)"', 1)
    return g.select("file", "font", at("unicode").alias("unicode"), at("d").alias("d"), F.nullif(at("horiz-adv-x"), F.lit("")).cast("double").alias("advance")).where("d != '' AND unicode != ''")


def fetch(get: Callable[[str], tuple[int, dict[str, str], bytes]], url: str, retries: int = 3, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[int, bytes]:
    """GET with retries: a 429 waits as its Retry-After says, server errors wait twice as long each time, other answers stand."""
    for n in range(retries + 1):
        status, headers, body = get(url)
        if n == retries or status != 429 and status < 500:
            return status, body
        try:
            wait = float(headers.get("Retry-After", "")) if status == 429 else delay * 2**n
        except ValueError:
            wait = delay * 2**n
        sleep(wait)
    return status, body


def paginate(get_page: Callable[[int], Sequence[str]], most: int) -> Iterator[tuple[int, str]]:
    """(page, url) of urls not seen before; stops at an empty page, a page of known urls, an error or the limit."""
    seen: set[str] = set()
    for page in range(1, most + 1):
        try:
            urls = get_page(page)
        except OSError:
            return
        new = [u for u in dict.fromkeys(urls) if u not in seen]
        if not new:
            return
        seen.update(new)
        for u in new:
            yield page, u


class PageSource(DataSource):
    """A Python data source of paged listings; ``fetcher`` is the import path of a function (category, page) -> list of urls."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "category string, page int, url string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    """A partition for each category."""

    def __init__(self, options):
        self.categories, self.most, self.options = options["categories"].split(","), int(options.get("max_pages", "100")), dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.categories]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        get = fetcher_of(self.options)
        for page, url in paginate(lambda p: get(partition.value, p), self.most):
            yield partition.value, page, url


def fetcher_of(options) -> Callable[[str, int], list[str]]:
    """The function (category, page) -> urls of the options: ``fetcher`` is its import path; ``base``, if given, its first argument."""
    import importlib

    module, _, function = options["fetcher"].rpartition(".")
    get = getattr(importlib.import_module(module), function)
    return (lambda category, page: get(options["base"], category, page)) if options.get("base") else get


class PageStream(DataSource):
    """Paged listings as a stream (category, page, url), one category after the other; it goes on at the page where a stopped query ended.

    Options: ``categories`` (joined by commas), ``fetcher``, ``base``, ``max_pages`` of a category, ``pages`` to read in a batch.
    """

    @classmethod
    def name(cls) -> str:
        return "paged-stream"

    def schema(self) -> str:
        return "category string, page int, url string"

    def simpleStreamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(self.options)


class PageStreamReader(SimpleDataSourceStreamReader):
    """An offset is the next page and its category, and the urls of the page before, by which a repeated last page is known.

    A site is asked by one client, page by page, so the few pages of a batch are read where the query is planned.
    """

    def __init__(self, options):
        self.categories, self.most, self.a_batch, self.get = options["categories"].split(","), int(options.get("max_pages", "100")), int(options.get("pages", "10")), fetcher_of(options)

    def initialOffset(self) -> dict:
        return {"category": 0, "page": 1, "before": []}

    def _next(self, at: dict) -> tuple[list[tuple[str, int, str]], dict]:
        """The new urls of a page, and where to go on: with the next category after a page without any, or an error."""
        category, page = self.categories[at["category"]], at["page"]
        try:
            urls = list(dict.fromkeys(self.get(category, page)))
        except OSError:
            urls = []
        new = [u for u in urls if u not in set(at["before"])]
        if not new or page >= self.most:
            return [(category, page, u) for u in new], {"category": at["category"] + 1, "page": 1, "before": []}
        return [(category, page, u) for u in new], {"category": at["category"], "page": page + 1, "before": urls}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start
        for _ in range(self.a_batch):
            if at["category"] >= len(self.categories):
                break
            more, at = self._next(at)
            rows += more
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """What a batch that failed had begun to read."""
        at = start
        while (at["category"], at["page"]) < (end["category"], end["page"]):
            rows, at = self._next(at)
            yield from rows


def names_below(path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return [f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(inner, allow_not_found=True))]


def listed_page(base: str, category: str, page: int) -> list[str]:
    """The urls of a page of a listing that is kept as text files below ``base``, in folders ``category=`` and ``page=``."""
    fs, inner = pyarrow.fs.FileSystem.from_uri(base if "://" in base else f"file://{base.removeprefix('file:')}")
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{inner}/category={category}/page={page}", allow_not_found=True))
    out = []
    for f in sorted(found, key=lambda f: f.path):
        if f.is_file and f.base_name.startswith("part-"):
            with fs.open_input_stream(f.path) as s:
                out += s.read().decode().splitlines()
    return out


#: Fixed value: pages of a listing that lie in one file.
PAGES_A_FILE = 100


def write_listing(rows: DataFrame, base: str, order: str) -> None:
    """Rows (category, page, url) as a listing for ``page_of_listing``, a file for a hundred pages; urls of a page are in the order of a column."""
    block = F.floor(F.col("page") / PAGES_A_FILE).cast("int")
    kept = rows.withColumn("block", block).repartition("category", "block").sortWithinPartitions("category", "block", "page", order)
    kept.select("category", "block", "page", "url").write.partitionBy("category", "block").parquet(base)


def page_of_listing(base: str, category: str, page: int) -> list[str]:
    """The urls of a page of a listing that ``write_listing`` wrote; none if it has no such page."""
    import pyarrow.parquet

    fs, inner = pyarrow.fs.FileSystem.from_uri(base if "://" in base else f"file://{base.removeprefix('file:')}")
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{inner}/category={category}/block={page // PAGES_A_FILE}", allow_not_found=True))
    out = []
    for f in sorted(found, key=lambda f: f.path):
        if f.is_file and f.base_name.startswith("part-"):
            with fs.open_input_file(f.path) as s:
                out += pyarrow.parquet.ParquetFile(s).read().filter(pyarrow.compute.field("page") == page)["url"].to_pylist()
    return out


def svg_font_map(glyphs: DataFrame) -> DataFrame:
    """font, glyphs: a map from each character to its outline and advance; of repeated characters the smallest outline."""
    one = glyphs.groupBy("font", "unicode").agg(F.min(F.struct("d", "advance")).alias("g"))
    return one.groupBy("font").agg(F.map_from_entries(F.collect_list(F.struct("unicode", "g"))).alias("glyphs"))


def register(spark: SparkSession) -> None:
    """Make the paged sources known to a session."""
    from ..session import ship

    ship(spark)
    spark.dataSource.register(PageSource)
    spark.dataSource.register(PageStream)


def fetch_all(df: DataFrame, key: str, url: str, server: str, retries: int = 3, delay: float = 1.0, wait: bool = False) -> DataFrame:
    """key, status, body, waited of each row's url; ``server`` is the import path of a function (url, attempt) -> (status, headers, body).

    With ``wait`` the tasks sleep as told; without it the seconds are only added up.
    """
    import pandas as pd

    from ..session import ship

    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import importlib

        module, _, function = server.rpartition(".")
        ask = getattr(importlib.import_module(module), function)
        for f in frames:
            rows = []
            for k, u in f.itertuples(index=False):
                waits, tries = [], iter(range(retries + 1))

                def pause(seconds: float, waits: list[float] = waits) -> None:
                    waits.append(seconds)
                    if wait:
                        time.sleep(seconds)

                status, body = fetch(lambda x, tries=tries: ask(x, next(tries)), u, retries, delay, pause)
                rows.append((k, status, body, float(sum(waits))))
            yield pd.DataFrame(rows, columns=[key, "status", "body", "waited"])

    return df.select(key, url).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, status int, body binary, waited double")


_ANSWERS: dict[str, str] = {}


def answered_once(name: str, load: Callable[[], str]) -> str:
    """What ``load`` gave when it was first asked for by this name; a process asks once."""
    if name not in _ANSWERS:
        _ANSWERS[name] = load()
    return _ANSWERS[name]


def api_rows(spark: SparkSession, text: str, field: str, schema: str) -> DataFrame:
    """The rows of the array ``field`` in a guarded JSON answer."""
    answer = spark.createDataFrame([(text,)], "text string")
    return answer.select(F.inline(guarded_json(F.col("text"), f"`{field}` array<struct<{schema}>>")[field]))
