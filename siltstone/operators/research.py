"""Web sources for a topic: discovery, extraction, robots rules, quality, deduplication in arrival order, staging."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.durable import is_missing, sums_before, written
from siltstone.functions import text as T

URL = r"https?://[^\s<>\"'\]\)]+"


def seeds(spark: SparkSession, urls: list[str]) -> DataFrame:
    return spark.createDataFrame([(u,) for u in urls], "url string").select("url", F.lit("seed").alias("via"))


def urls_in(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, url) of the distinct links of each text outside code fences, without trailing punctuation."""
    bare = F.regexp_replace(text, r"(?s)```.*?```", "")
    found = F.transform(F.regexp_extract_all(bare, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    return documents.select(key, F.explode(F.array_distinct(found)).alias("url"))


def from_feed(xml: Column) -> Column:
    """array<struct<url, title, published>> of an RSS or Atom text."""
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))
    tag = lambda x, name: F.trim(F.regexp_replace(F.regexp_extract(x, rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1), r"^\s*<!\[CDATA\[|\]\]>\s*$", ""))
    href = lambda x: F.coalesce(F.nullif(tag(x, "link"), F.lit("")), F.nullif(F.regexp_extract(x, r"<link\b[^>]*href=\"([^\"]+)\"", 1), F.lit("")), tag(x, "id"))
    return F.transform(items, lambda x: F.struct(href(x).alias("url"), tag(x, "title").alias("title"), F.coalesce(F.nullif(tag(x, "pubDate"), F.lit("")), tag(x, "published")).alias("published")))


def from_search(answer: Column) -> Column:
    """URLs of a search provider's JSON answer (results or web.results)."""
    one = "array<struct<url:string,title:string>>"
    return F.coalesce(F.from_json(F.get_json_object(answer, "$.results"), one), F.from_json(F.get_json_object(answer, "$.web.results"), one))


class _Markdown(HTMLParser):
    """Readable text of a page: headings, paragraphs, lists, code and links as Markdown, without navigation, scripts and forms."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "svg", "iframe", "button"}
    BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "br", "li", "pre", *(f"h{n}" for n in range(1, 7))}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.pre, self.href, self.title, self.in_title = 0, 0, None, "", False

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        if self.skip:
            return
        if tag in self.BLOCK:
            self.out.append("\n" if tag in ("br", "li", "tr") else "\n\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("- ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("```\n")
        elif tag == "a":
            self.href = dict(attrs).get("href")
            self.out.append("[" if self.href else "")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        if self.skip:
            return
        if tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href})")
            self.href = None
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))

    def text(self) -> str:
        lines = "".join(self.out).split("\n")
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() if x.startswith("```") else x.strip() for x in lines)).strip()


def html_to_markdown(html: str | None) -> tuple[str, str]:
    """(title, body) of a page; what can't be parsed further is kept as far as it came."""
    p = _Markdown()
    p.feed(html or "")
    p.close()
    return p.title.strip(), p.text()


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with title, body_md, canonical_url, id, language, word_count and body_hash."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [html_to_markdown(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([m for _, m in got], pa.string())], ["page_id", "url", "title", "body_md"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, title string, body_md string")
    url = T.canonical_url(F.col("url"))
    return out.withColumns({"canonical_url": url, "id": T.source_id(url), "language": T.language_guess(F.col("body_md")), "word_count": T.word_count(F.col("body_md")), "body_hash": T.body_hash(F.col("body_md"))})


def robots_allows(rules: str, agent: str, path: str) -> bool:
    """Whether a robots text lets an agent read a path: the agent's own group, else the one for all; the longest prefix decides, allow on ties."""
    groups: dict[str, list[tuple[str, str]]] = {}
    names, open_ = [], False
    for line in rules.split("\n"):
        key, _, value = (x.strip() for x in line.split("#")[0].partition(":"))
        key = key.lower()
        if key == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
            for n in names:
                groups.setdefault(n, [])
        elif key in ("allow", "disallow"):
            open_ = False
            if value:
                for n in names:
                    groups[n].append((key, value))
    best = max(((len(p), k == "allow") for k, p in groups.get(agent.lower(), groups.get("*", [])) if path.startswith(p)), default=(0, True))
    return best[1]


#: Undecided pages that one task may go through in order (three short values each).
FEW = 50_000


def _one_after_the_other(left: DataFrame, order: str) -> DataFrame:
    """(order) of the pages accepted, by one ordered pass."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        urls, bodies = set(), set()
        for b in batches:
            kept = []
            for k, (u, h) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if (u is None or u not in urls) and (h is None or h not in bodies):
                    kept.append(k)
                    urls.add(u)
                    bodies.add(h)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64()))], [order])

    return written(left.repartition(1).sortWithinPartitions(order).mapInArrow(run, f"{order} {left.schema[order].dataType.simpleString()}"), "accepted")


def first_seen(pages: DataFrame, order: str = "page_id", few: int = FEW) -> DataFrame:
    """pages with accepted: in arrival order (which tells pages apart), a page goes if its canonical URL or its body was accepted before; what is rejected reserves neither, and a null is shared with nobody.

    The sequential rule by rounds: of the undecided pages those that come first both among their URL's and among their body's are accepted, as nothing before them can be, and all that share with them go; once `few` are left, a single task goes through those in order, so a chain of pages that each share with the next costs no round a link unless there are more. A page a third of all pages copy is decided in one round, by aggregates and narrow joins."""
    left = written(pages.select(order, F.col("canonical_url").alias("u"), F.col("body_hash").alias("b")), "seen")
    accepted = None
    while n := left.count():
        if n <= few:
            now = _one_after_the_other(left, order)
            accepted = now if accepted is None else accepted.unionByName(now)
            break
        firsts = left
        for c in ("u", "b"):
            least = left.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias(f"first_{c}"))
            firsts = firsts.join(least, c, "left")
        own = F.col(order)
        now = written(firsts.filter((F.coalesce("first_u", own) == own) & (F.coalesce("first_b", own) == own)).select(order, "u", "b"), "accepted")
        left = left.join(now.select(order), order, "left_anti")
        for c in ("u", "b"):
            left = left.join(now.filter(F.col(c).isNotNull()).select(c).distinct(), c, "left_anti")
        left = written(left.select(order, "u", "b"), "seen")
        accepted = now.select(order) if accepted is None else accepted.unionByName(now.select(order))
    if accepted is None:
        return pages.withColumn("accepted", F.lit(True))
    return pages.join(accepted.withColumn("accepted", F.lit(True)), order, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def budgeted(pages: DataFrame, most_urls: int = 100, most_bytes: int = 50 * 1024 * 1024, topic: str | None = None, order: str = "page_id") -> DataFrame:
    """Pages in arrival order up to the first that would overflow the budget of URLs or bytes, over all or per topic, whose pages then meet in a task."""
    size = F.coalesce(F.octet_length("body_md"), F.lit(0)).cast("long")
    if topic is None:
        counted = sums_before(pages, [order], _n=F.lit(1), _b=size)
        return counted.filter((F.col("_n") < most_urls) & (F.col("_b") + size <= most_bytes)).drop("_n", "_b")
    w = Window.partitionBy(topic).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum(size).over(upto)).filter((F.col("_n") <= most_urls) & (F.col("_b") <= most_bytes)).drop("_n", "_b")


def stage(pages: DataFrame, path: str) -> None:
    """Append new records to the staging files, those not there yet by id."""
    spark = pages.sparkSession
    try:
        known = spark.read.json(path, schema="id string")
        fresh = pages.join(known.dropna().distinct(), "id", "left_anti")
    except AnalysisException as e:
        if not is_missing(e):
            raise
        fresh = pages
    fresh.dropDuplicates(["id"]).write.mode("append").json(path)


def load_staged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Staged records, the first of each id, without lines that don't parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).dropDuplicates(["id"])


def run_status(events: DataFrame) -> DataFrame:
    """(topic, fetched, accepted, rejected, cost, last_event) of run logs (topic, ts, kind, cost)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return events.groupBy("topic").agg(n("fetched").alias("fetched"), n("accepted").alias("accepted"), n("rejected").alias("rejected"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.max_by("kind", "ts").alias("last_event"))
