"""Research topics: their settings, what becomes of offered pages, the run log, and searches within a topic."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.durable import sums_before, written
from siltstone.functions import text as T
from siltstone.operators.research import extract_pages, first_seen, run_status
from siltstone.plans import search

#: What a topic may say, with defaults, and what each kind of source needs and may say, with bounds. Fixed values.
TOPIC = {"description": "", "languages": [], "sources": []}
FILTERS = {"min_words": 200, "max_words": 50_000, "exclude_domains": [], "require_lang": None}
BUDGET = {"max_new_urls": 100, "max_total_bytes": 50_000_000}
SOURCES = {
    "web-search": (["queries"], {"site_filters": [], "since": None, "top_k_per_query": 10}),
    "arxiv": (["queries"], {"categories": [], "top_k": 30}),
    "rss": (["feeds"], {}),
    "seed-urls": (["urls"], {}),
    "from-document": (["path"], {}),
}
BOUNDS = {"top_k_per_query": (1, 50), "top_k": (1, 200), "min_words": (0, None), "max_words": (0, None), "max_new_urls": (1, None), "max_total_bytes": (1, None)}
URLS = {"feeds", "urls"}


def _settled(where: str, given: dict, needed: list[str], defaults: dict) -> dict:
    out = {**{k: list(v) if isinstance(v, list) else v for k, v in defaults.items()}, **given}
    for k in needed:
        if not given.get(k):
            raise ValueError(f"{where}.{k} is missing")
        if k in URLS and not all(isinstance(u, str) and re.match(r"[a-z][a-z0-9+.-]*://\S+$", u) for u in given[k]):
            raise ValueError(f"{where}.{k} has what is no URL")
    for k, (low, high) in BOUNDS.items():
        if k in out and (not isinstance(out[k], int) or out[k] < low or (high is not None and out[k] > high)):
            raise ValueError(f"{where}.{k} is out of bounds")
    return out


def settled(topic: dict) -> dict:
    """A topic's settings with defaults; what can't be right is an error that names it."""
    if not re.fullmatch("[a-z0-9-]+", topic.get("id") or ""):
        raise ValueError("topic.id has lower-case letters, digits and dashes only")
    if not isinstance(topic.get("title"), str):
        raise ValueError("topic.title is missing")
    out = _settled("topic", topic, [], TOPIC)
    for i, s in enumerate(out["sources"]):
        if s.get("type") not in SOURCES:
            raise ValueError(f"sources.{i}.type is unknown")
    out["sources"] = [_settled(f"sources.{i}", s, *SOURCES[s["type"]]) for i, s in enumerate(out["sources"])]
    out["filters"] = _settled("filters", topic.get("filters") or {}, [], FILTERS)
    out["budget"] = _settled("budget", topic.get("budget") or {}, [], BUDGET)
    return out


def scaffold(topic_id: str, title: str | None = None) -> dict:
    """A topic with nothing but a name, to be filled in."""
    return settled({"id": topic_id, "title": title or topic_id})


def prompted(prompt: str) -> dict:
    """A topic made up for one prompt, which is what it searches for."""
    return settled({"id": slug_of(prompt) or "draft", "title": prompt, "sources": [{"type": "web-search", "queries": [prompt]}]})


def slug_of(prompt: str) -> str:
    """The first six words, 40 characters at most."""
    return re.sub("[^a-z0-9-]", "", "-".join(prompt.lower().split()[:6]))[:40] or "draft"


def outcomes(pages: DataFrame, staged: DataFrame, topic: dict, order: str = "page_id") -> DataFrame:
    """pages (order, url, body_md, content_type, n_bytes, language; order is that of arrival and tells pages apart) with canonical_url, body_hash and outcome: accepted; known, if the URL was staged or accepted before, which costs nothing; what a page breaks otherwise (content_type, empty_body, a rule of quality, seen for a body accepted before); halted, from the first page on that the budget of URLs or bytes does not allow.

    staged has canonical_url and body_hash."""
    f, b = topic["filters"], topic["budget"]
    url = T.canonical_url(F.col("url"))
    verdict = T.quality_verdict(F.col("body_md"), url, F.col("language"), f["min_words"], f["max_words"], f["exclude_domains"], [f["require_lang"]] if f["require_lang"] else None)
    rows = pages.withColumns({"canonical_url": url, "body_hash": T.body_hash(F.col("body_md"))})
    broken = F.when(~F.col("content_type").isin("html", "pdf"), F.concat(F.lit("content_type:"), F.col("content_type"))).when(F.coalesce("body_md", F.lit("")) == "", "empty_body").when(verdict != "ok", verdict)
    rows = rows.withColumn("_broken", broken)
    old = lambda c, name: staged.filter(F.col(c).isNotNull()).select(c).distinct().withColumn(name, F.lit(True))
    rows = rows.join(old("canonical_url", "_url_staged"), "canonical_url", "left").join(old("body_hash", "_body_staged"), "body_hash", "left")
    fresh = rows.filter("_broken is null and _url_staged is null and _body_staged is null")
    first = first_seen(fresh.select(order, "canonical_url", "body_hash"), order).filter("accepted").select(F.col(order).alias("_at"), "canonical_url")
    rows = rows.join(first.withColumnRenamed("_at", "_first"), "canonical_url", "left")
    known = F.col("_url_staged").isNotNull() | F.coalesce(F.col("_first") < F.col(order), F.lit(False))
    own = F.coalesce(F.col("_first") == F.col(order), F.lit(False))
    rows = rows.withColumn("outcome", F.when(known, "known").when(own, "accepted").when(F.col("_broken").isNotNull(), F.col("_broken")).otherwise("seen"))
    cost = lambda c: F.when(F.col("outcome") == "known", F.lit(0)).otherwise(c).cast("long")
    spent = sums_before(rows, [order], _n=cost(F.lit(1)), _b=cost(F.col("n_bytes")))
    over = (F.col("outcome") != "known") & ((F.col("_n") >= b["max_new_urls"]) | (F.col("_b") + F.col("n_bytes") > b["max_total_bytes"]))
    halt = spent.agg(F.min(F.when(over, F.col(order))).alias("h")).first()["h"]
    if halt is not None:
        spent = spent.withColumn("outcome", F.when(F.col(order) >= halt, "halted").otherwise(F.col("outcome")))
    return spent.select(*pages.columns, "canonical_url", "body_hash", "outcome")


def append_log(events: DataFrame, path: str) -> None:
    """Run events (topic, ts, kind, cost) as JSON lines, after those that are there."""
    events.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("topic string, ts string, kind string, cost double").json(path)


def source_of(path: Column) -> Column:
    """The source id in the path of a source's card, or null."""
    return F.nullif(F.regexp_extract(path, r"sources/([0-9a-f]{12})\.md", 1), F.lit(""))


def search_topic(index: search.Index, topic_id: str, query: str, limit: int = 12, **options) -> DataFrame:
    """(source_id, title, path, score): what a topic's notes hold on a query, sources only."""
    hits = search.hybrid(index, query, collection=f"research-{topic_id}", limit=limit, **options)
    named = hits.select("file", "score").join(index.documents.select(F.col("id").alias("file"), "title", "path"), "file")
    return named.withColumn("source_id", source_of(F.col("path"))).filter("source_id is not null").select("source_id", "title", "path", "score")


def due(requests: DataFrame, per_second: float, order: str = "page_id") -> DataFrame:
    """requests (order, url) with the second at which each may go out, so that a host sees per_second of them at most."""
    from pyspark.sql import Window

    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    return requests.withColumn("at", (F.row_number().over(Window.partitionBy(host).orderBy(order)) - 1) / F.lit(per_second))


def conditional(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (canonical_url) with the headers that let an unchanged page be answered from the cache (canonical_url, etag, last_modified)."""
    held = cache.groupBy("canonical_url").agg(F.max(F.struct("last_modified", "etag")).alias("h"))
    return requests.join(held, "canonical_url", "left").withColumn("if_none_match", F.col("h.etag")).withColumn("if_modified_since", F.col("h.last_modified")).drop("h")


FETCHED = "status int, content_type string, body string, etag string, last_modified string, error string"
CACHE = "canonical_url string, etag string, last_modified string, content_type string, body string, fetched string"


def by_calls(fetcher, robots=None, agent: str = "siltstone", order: str = "page_id"):
    """requests (order, canonical_url, if_none_match, if_modified_since) to their answers by an injected fetcher (url, headers to status, content_type, body, headers), a host in one task after the other. robots gives a host's rules; what they forbid is not fetched, and a call that fails keeps its error."""
    import pyarrow as pa

    from siltstone.operators.research import robots_allows

    def fetch(requests: DataFrame) -> DataFrame:
        kind = requests.schema[order].dataType.simpleString()
        host = F.lower(F.regexp_extract("canonical_url", r"^[a-zA-Z]+://([^/?#]+)", 1))

        def run(batches):
            rules: dict[str, str] = {}
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    path = "/" + r["canonical_url"].split("://", 1)[-1].partition("/")[2]
                    headers = {k: v for k, v in (("If-None-Match", r["if_none_match"]), ("If-Modified-Since", r["if_modified_since"])) if v}
                    row = dict.fromkeys(("status", "content_type", "body", "etag", "last_modified", "error"))
                    try:
                        if robots is not None:
                            if len(rules) > 1000:
                                rules.clear()
                            if r["host"] not in rules:
                                rules[r["host"]] = robots(r["host"]) or ""
                            if not robots_allows(rules[r["host"]], agent, path):
                                raise PermissionError("robots")
                        status, content_type, body, said = fetcher(r["canonical_url"], headers)
                        row.update(status=status, content_type=content_type, body=body, etag=said.get("ETag"), last_modified=said.get("Last-Modified"))
                    except Exception as e:
                        row["error"] = "robots" if isinstance(e, PermissionError) else f"{type(e).__name__}: {e}"
                    rows.append({order: r[order], **row})
                types = [("status", pa.int32()), *((c, pa.string()) for c in ("content_type", "body", "etag", "last_modified", "error"))]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([b.schema.field(order), *types]))

        asked = requests.select(order, "canonical_url", "if_none_match", "if_modified_since", host.alias("host"))
        return asked.repartition("host").sortWithinPartitions("host", order).mapInArrow(run, f"{order} {kind}, {FETCHED}")

    return fetch


def run(found: DataFrame, fetch, topic: dict, staged: DataFrame, cache: DataFrame, now: str, order: str = "page_id") -> dict[str, DataFrame]:
    """A topic's run over found URLs (order, url), in that order: pages with their outcomes, the records to stage, what goes into the cache, and events for the log.

    What was staged before is known and costs nothing; of the rest as many are fetched as the budget has URLs, each with the headers of its copy in the cache (CACHE), which is taken where the page hasn't changed. Then outcomes() decides. Budgets of bytes are of what was fetched."""
    rows = found.select(order, "url", T.canonical_url(F.col("url")).alias("canonical_url"))
    known = staged.filter("canonical_url is not null").select("canonical_url").distinct()
    first = rows.groupBy("canonical_url").agg(F.min(order).alias(order))  # a URL is fetched once
    fresh = rows.join(first, ["canonical_url", order]).join(known, "canonical_url", "left_anti").orderBy(order).limit(topic["budget"]["max_new_urls"])
    got = written(fetch(conditional(fresh, cache)), "fetched")
    copies = cache.groupBy("canonical_url").agg(F.max_by(F.struct("content_type", "body"), F.struct("last_modified", "etag")).alias("copy"))
    whole = fresh.join(got, order).join(copies, "canonical_url", "left")
    same = F.col("status") == 304
    content_type, raw = F.when(same, F.col("copy.content_type")).otherwise(F.col("content_type")), F.when(same, F.col("copy.body")).otherwise(F.col("body"))
    failed = F.when(F.col("error").isNotNull(), F.when(F.col("error") == "robots", "robots").otherwise("error")).when(~same & ~F.col("status").between(200, 299), F.concat(F.lit("status:"), "status"))
    whole = whole.select(order, "url", "canonical_url", content_type.alias("content_type"), raw.alias("raw"), F.coalesce(F.octet_length(raw), F.lit(0)).alias("n_bytes"), failed.alias("failed"))
    good = written(whole, "answers")
    texts = extract_pages(good.filter("failed is null and content_type = 'html'").select(F.col(order).cast("long").alias("page_id"), "url", F.col("raw").alias("html"))).select(F.col("page_id").cast(good.schema[order].dataType).alias(order), "title", "body_md", "language")
    read = good.filter("failed is null").join(texts, order, "left")
    read = read.withColumns({"body_md": F.coalesce("body_md", "raw"), "language": F.coalesce("language", T.language_guess(F.col("raw")))})
    again = rows.join(good.select(order), order, "left_anti").join(known, "canonical_url", "left_semi").select(order, "url", F.lit("html").alias("content_type"), F.lit("").alias("body_md"), F.lit(0).alias("n_bytes"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("title"))
    pages = read.select(again.columns).unionByName(again)
    decided = written(outcomes(pages, staged, topic, order), "outcomes")
    ended = good.filter("failed is not null").select(order, "url", F.col("failed").alias("outcome"))
    every = decided.select(order, "url", "outcome").unionByName(ended)
    accepted = decided.filter("outcome = 'accepted'").select(order, T.source_id(F.col("canonical_url")).alias("id"), "url", "canonical_url", "title", "body_md", "body_hash", "language", F.lit(now).alias("fetched"))
    kept = fresh.join(got.filter("status between 200 and 299 and (etag is not null or last_modified is not null)"), order).select("canonical_url", "etag", "last_modified", "content_type", "body", F.lit(now).alias("fetched"))
    kind = F.when(F.col("outcome") == "accepted", "accepted").when(F.col("outcome").isin("known", "seen", "halted"), F.col("outcome")).otherwise("rejected")
    told = every.select(F.lit(topic["id"]).alias("topic"), F.lit(now).alias("ts"), kind.alias("kind"), F.lit(0.0).alias("cost"))
    calls = got.filter("status is not null").select(F.lit(topic["id"]).alias("topic"), F.lit(now).alias("ts"), F.lit("fetched").alias("kind"), F.lit(0.0).alias("cost"))
    return {"pages": every, "records": accepted, "cache": kept, "events": told.unionByName(calls)}


def listed(topics: list[dict], events: DataFrame) -> DataFrame:
    """(topic, title, sources, fetched, accepted, rejected, last_event) of topics and what their runs logged; one that never ran has none."""
    named = events.sparkSession.createDataFrame([(t["id"], t["title"], len(t["sources"])) for t in map(settled, topics)], "topic string, title string, sources int")
    return named.join(run_status(events), "topic", "left").select("topic", "title", "sources", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fetched", "accepted", "rejected")], "last_event")
