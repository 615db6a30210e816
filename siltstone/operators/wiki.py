"""Pages with front matter, links between them, importance and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import let

COUNTERS = ["show_count", "append_count", "update_count", "link_count", "merge_count", "search_count", "query_count"]


def importance(show: Column, append: Column, update: Column, link: Column, merge: Column) -> Column:
    return show + 2 * append + update + link + 3 * merge


def scored(pages: DataFrame) -> DataFrame:
    c = {n: F.coalesce(n, F.lit(0)) for n in COUNTERS}
    return pages.withColumn("importance", importance(*[c[n] for n in COUNTERS[:5]])).withColumn("hit_count", c["search_count"] + c["query_count"])


def front_matter(text: Column) -> Column:
    """struct<title, project, tags, sources, related, created, updated, body> of a page with a front matter block."""

    def parse(block: Column) -> Column:
        value = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?m)^{k}:[ \t]*(.*)$", 1), r"^[\"']|[\"']$", "")), F.lit(""))

        def listed(k: str) -> Column:
            inline = F.split(F.regexp_extract(block, rf"(?m)^{k}:[ \t]*\[(.*)\][ \t]*$", 1), ",")
            lines = F.split(F.regexp_extract(block, rf"(?m)^{k}:[ \t]*\n((?:[ \t]*-[ \t].*\n?)*)", 1), "\n")
            clean = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s*-\s", "")), r"^[\"']|[\"']$", "")), lambda x: x != "")
            return F.concat(clean(inline), clean(lines))

        body = F.when(text.rlike(r"^---\n"), F.regexp_replace(text, r"(?s)^---\n.*?\n---\n*", "")).otherwise(text)
        return F.struct(value("title").alias("title"), value("project").alias("project"), listed("tags").alias("tags"), listed("sources").alias("sources"), listed("related").alias("related"), value("created").alias("created"), value("updated").alias("updated"), body.alias("body"))

    return let(F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1), parse)


def render(pages: DataFrame) -> DataFrame:
    """pages with text: front matter and body; counters are written only if one isn't zero."""
    many = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", "), F.lit("]"))
    lines = [F.concat(F.lit("title: "), F.col("title")), F.concat(F.lit("project: "), F.col("project")), F.concat(F.lit("tags: "), many("tags")), F.concat(F.lit("sources: "), many("sources")), F.concat(F.lit("related: "), many("related"))]
    held = [n for n in COUNTERS if n in pages.columns]
    if held:
        used = F.greatest(*[F.coalesce(n, F.lit(0)) for n in held], F.lit(0)) > 0
        lines.append(F.when(used, F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), F.coalesce(n, F.lit(0)).cast("string")) for n in held])))
    return pages.withColumn("text", F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.col("body")))


def links(pages: DataFrame) -> DataFrame:
    """(project, title, target): [[target]] links of the pages' bodies."""
    return pages.select("project", "title", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))).alias("target"))


def backlinks(pages: DataFrame, same_project: bool = False) -> DataFrame:
    """(project, title, from_project, from_title): pages that link to each page, by an equi-join on the link's text."""
    out = links(pages).select(F.col("project").alias("from_project"), F.col("title").alias("from_title"), F.col("target").alias("title"))
    got = pages.select("project", "title").join(out, "title").filter("title <> from_title or project <> from_project")
    return got.filter("project = from_project") if same_project else got


def link(pages: DataFrame, project: str, a: str, b: str, remove: bool = False) -> DataFrame:
    """pages with a and b in each other's related lists, or out of them, and the section of links in the body in step."""
    here = F.col("project") == project
    other = F.when(here & (F.col("title") == a), b).when(here & (F.col("title") == b), a)
    old = F.coalesce("related", F.array().cast("array<string>"))
    related = F.when(other.isNull(), F.col("related")).otherwise(F.array_remove(old, other) if remove else F.array_union(old, F.array(other)))
    section = F.regexp_replace("body", r"(?s)\n*## Related\n.*$", "")
    listed = F.array_join(F.transform(F.col("related"), lambda t: F.concat(F.lit("- [["), t, F.lit("]]"))), "\n")
    body = F.when(other.isNull(), F.col("body")).when(F.size("related") > 0, F.concat(section, F.lit("\n\n## Related\n\n"), listed, F.lit("\n"))).otherwise(section)
    return pages.withColumn("related", related).withColumn("body", body)


def merge_into(pages: DataFrame, project: str, title: str, body: str, tags: list[str], source: str | None = None) -> DataFrame:
    """The page with a body appended, tags and sources united, and its merges counted."""
    at = (F.col("project") == project) & (F.col("title") == title)
    add = lambda c, new: F.when(at, F.array_distinct(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in new]).cast("array<string>")))).otherwise(F.col(c))
    return pages.withColumns({"body": F.when(at, F.concat(F.col("body"), F.lit("\n\n---\n\n" + body))).otherwise(F.col("body")), "tags": add("tags", tags), "sources": add("sources", [source] if source else []), "merge_count": F.when(at, F.coalesce("merge_count", F.lit(0)) + 1).otherwise(F.coalesce("merge_count", F.lit(0)))})


def bump(pages: DataFrame, hits: DataFrame, counter: str) -> DataFrame:
    """pages with a counter raised by the hits (project, title, n)."""
    n = hits.groupBy("project", "title").agg(F.sum("n").alias("_n"))
    return pages.join(n, ["project", "title"], "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def similar_pages(title_hits: DataFrame, body_hits: DataFrame, limit: int = 5) -> DataFrame:
    """(id, score) of pages by twice the title search's score and the body search's."""
    both = title_hits.select("id", (2 * F.col("score")).alias("s")).unionByName(body_hits.select("id", F.col("score").alias("s")))
    return both.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def index_page(pages: DataFrame, project: str) -> DataFrame:
    """One row: the project's index, pages under their tags with the first line cut at 60 characters; files that start with _ aren't listed."""
    first = F.regexp_extract("body", r"(?m)^\s*([^\s#].*)$", 1)
    brief = F.when(F.length(first) > 60, F.concat(F.substring(first, 1, 60), F.lit("..."))).otherwise(first)
    own = pages.filter((F.col("project") == project) & ~F.col("title").startswith("_"))
    tagged = own.select(F.explode(F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("untagged")))).alias("tag"), "title", brief.alias("brief"))
    item = F.concat(F.lit("- [["), F.col("title"), F.lit("]]"), F.when(F.col("brief") != "", F.concat(F.lit(" - "), F.col("brief"))).otherwise(""))
    groups = tagged.select("tag", F.struct("title", item.alias("item")).alias("x")).groupBy("tag").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]), "\n").alias("list"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tag", "list"))), lambda g: F.concat(F.lit("## "), g["tag"], F.lit("\n\n"), g["list"])), "\n\n")
    return groups.agg(F.concat(F.lit(f"# {project}\n\n"), whole, F.lit("\n")).alias("page"))


def overview(pages: DataFrame) -> dict[str, DataFrame]:
    """Project counts, the five pages changed last, the ten most hit, and up to five of importance 5 or more."""
    p = scored(pages)
    return {
        "projects": p.groupBy("project").agg(F.count("*").alias("pages")),
        "recent": p.orderBy(F.desc("updated"), "project", "title").limit(5),
        "top_hits": p.filter("hit_count > 0").orderBy(F.desc("hit_count"), "project", "title").limit(10),
        "important": p.filter("importance >= 5").orderBy("project", "title").limit(5),
    }


def create(pages: DataFrame, project: str, title: str, body: str = "", tags: list[str] | None = None, sources: list[str] | None = None, similar: str | None = None, merge: bool = False) -> DataFrame:
    """pages with a new one. A page that is alike (`similar`, a title found by similar_pages) takes the text in instead where merge is set, and is linked with the new page otherwise. A title that its project has already is an error."""
    if pages.filter((F.col("project") == project) & (F.col("title") == title)).limit(1).count():
        raise ValueError(f"{project} has a page {title!r} already")
    if similar is not None and merge:
        return merge_into(pages, project, similar, body, tags or [], title)
    given = {"project": F.lit(project), "title": F.lit(title), "body": F.lit(body), "tags": _strings(tags), "sources": _strings(sources), "related": _strings(None)}
    types = {f.name: f.dataType for f in pages.schema}
    new = pages.sparkSession.range(1).select(*[given.get(c, F.lit(0) if c in COUNTERS else F.lit(None)).cast(types[c]).alias(c) for c in pages.columns])
    out = pages.unionByName(new)
    return link(out, project, title, similar) if similar is not None else out


def _strings(values: list[str] | None) -> Column:
    return F.array(*[F.lit(v) for v in values or []]).cast("array<string>")


def update(pages: DataFrame, project: str, title: str, body: str | None = None, append: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """The page with another body, or with text after its own, and other tags; either is counted."""
    at = (F.col("project") == project) & (F.col("title") == title)
    out = pages
    if body is not None:
        out = out.withColumn("body", F.when(at, F.lit(body)).otherwise(F.col("body")))
    if append is not None:
        out = out.withColumn("body", F.when(at, F.concat("body", F.lit("\n\n" + append))).otherwise(F.col("body")))
    if tags is not None:
        out = out.withColumn("tags", F.when(at, _strings(tags)).otherwise(F.col("tags")))
    counter = "append_count" if append is not None else "update_count"
    return out.withColumn(counter, F.coalesce(counter, F.lit(0)) + at.cast("int"))


def remove(pages: DataFrame, project: str, title: str) -> DataFrame:
    """pages without one, and without links to it in its project's related lists."""
    kept = pages.filter(~((F.col("project") == project) & (F.col("title") == title)))
    return kept.withColumn("related", F.when(F.col("project") == project, F.array_remove("related", title)).otherwise(F.col("related")))


def listed(pages: DataFrame, project: str | None = None, tag: str | None = None) -> DataFrame:
    out = pages if project is None else pages.filter(F.col("project") == project)
    return out if tag is None else out.filter(F.array_contains("tags", tag))


def reset(pages: DataFrame, project: str | None = None) -> DataFrame:
    """pages with their counters, or a project's, at nothing."""
    at = F.lit(True) if project is None else F.col("project") == project
    return pages.withColumns({c: F.when(at, 0).otherwise(F.coalesce(c, F.lit(0))) for c in COUNTERS if c in pages.columns})


def reconcile(pages: DataFrame, documents: DataFrame, collection: str = "wiki") -> tuple[DataFrame, DataFrame]:
    """(documents with the collection's rows as the pages are, counts scanned and deactivated): pages are the truth, documents of pages that are gone turn inactive."""
    from siltstone.functions import text as T
    from siltstone.operators import index

    text = render(pages).select(F.concat_ws("/", "project", F.concat(T.slug(F.col("title")), F.lit(".md"))).alias("path"), "text")
    now = index.derive(text, collection)
    own = documents.filter(F.col("collection") == collection).select(now.columns)
    out = index.merge(own, now)
    gone = own.filter("active").join(now, ["collection", "path"], "left_anti")
    counts = now.agg(F.count("*").alias("scanned")).crossJoin(F.broadcast(gone.agg(F.count("*").alias("deactivated"))))  # one row each
    return documents.filter(F.col("collection") != collection).select(now.columns).unionByName(out), counts


def page_detail(pages: DataFrame, project: str, title: str) -> DataFrame:
    """A page with its importance, hits and how many pages link to it."""
    own = scored(pages).filter((F.col("project") == project) & (F.col("title") == title))
    into = backlinks(pages).filter((F.col("project") == project) & (F.col("title") == title)).agg(F.count("*").alias("linked_from"))
    return own.crossJoin(F.broadcast(into))  # one row each
