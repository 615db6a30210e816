"""More of the catalogue: a stored index, embedding, page edits, request schedules and formats; each with the SQL it must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone.durable import shared_dir
from siltstone.functions import text as T
from siltstone.operators import chunk, formatter, research, topic, vector, wiki
from siltstone.plans.catalog import CANON, CHUNKS, PAGES, SCORED, _bm25_sql, documents, pages, query, table
from siltstone.plans.catalog_sets import THINGS, _chunks
from siltstone.store import Store
from siltstone.streaming import idle

# --- a store


@query(_bm25_sql([(THINGS, False), ("starts_with($[i], 'th')", False)], f"SELECT id, {SCORED} FROM r ORDER BY bm DESC, id LIMIT 20"))
def stored_search(spark, sf_dir):
    """A store written in three versions: some texts, those and others with changes, and all as they are; searched by stems over its segments without what is dead."""
    d = documents(spark, sf_dir).drop("id", "filepath")
    s = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    changed = F.concat("body", F.lit(" things that are gone"))
    old = d.filter("doc_id % 3 = 1").withColumn("body", changed)
    s.commit(d.filter("doc_id % 3 = 0").unionByName(old.withColumn("hash", T.content_hash(F.col("body")))))
    s.commit(d.filter("doc_id % 3 <> 2"))
    s.commit(d)
    return s.index().lexical('"things" th').select("id", F.round("score", 6).alias("score"))


# --- vectors


@query(f", {CHUNKS} SELECT id AS hash, seq, CASE WHEN contains(text, 'thing') THEN NULL ELSE length(text) END AS size, CASE WHEN contains(text, 'thing') THEN 'ValueError: thing' END AS error FROM ck")
def embedded_chunks(spark, sf_dir):
    """Every chunk by a model that gives its length and fails on some texts: those keep their error."""

    def model(texts):
        if any("thing" in t for t in texts):
            raise ValueError("thing")
        return [[float(len(t))] for t in texts]

    cut = chunk.chunk_documents(documents(spark, sf_dir), "id", "body").withColumnRenamed("id", "hash")
    got = vector.embed(cut, model, most_errors=1.0)
    return got.select("hash", "seq", F.get("embedding", F.lit(0)).cast("long").alias("size"), "error")


VARIANTS = """near2 AS (SELECT w, vec_id, round(1 - list_dot_product(e, we) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(we, we))), 12) AS dist FROM v SEMI JOIN documents ON doc_id = vec_id, (SELECT vec_id AS w, e AS we FROM v WHERE vec_id IN (0, 1)) x),
n30 AS (SELECT * FROM near2 QUALIFY row_number() OVER (PARTITION BY w ORDER BY dist, CAST(vec_id AS VARCHAR)) <= 30),
f10 AS (SELECT w, d.id, min(dist) AS dist FROM n30 JOIN d o ON o.doc_id = n30.vec_id JOIN d ON d.hash = o.hash GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY w ORDER BY min(dist), d.id) <= 10)"""


@query(f", {VARIANTS} SELECT id, round(max(1 - dist), 6) AS score FROM f10 GROUP BY id HAVING max(1 - dist) >= 0.3 ORDER BY max(1 - dist) DESC, id LIMIT 10")
def vector_variants(spark, sf_dir):
    """Files by their best score over two query vectors."""
    first = {r["vec_id"]: r["embedding"] for r in table(spark, sf_dir, "embeddings").filter("vec_id in (0, 1)").select("vec_id", "embedding").collect()}
    return vector.search_variants(_chunks(spark, sf_dir), documents(spark, sf_dir), [first[0], first[1]]).select("id", F.round("score", 6).alias("score"))


# --- pages


@query(f""", {PAGES}, sc AS (SELECT project, title, c0 + 2 * c1 + c2 + c3 + 3 * c4 AS importance, c5 + c6 AS hits FROM p)
SELECT 'recent' AS kind, project, title FROM (SELECT * FROM sc ORDER BY project, title LIMIT 5) UNION ALL SELECT 'top_hits', project, title FROM (SELECT * FROM sc WHERE hits > 0 ORDER BY hits DESC, project, title LIMIT 10)
UNION ALL SELECT 'important', project, title FROM (SELECT * FROM sc WHERE importance >= 5 ORDER BY project, title LIMIT 5)""")
def page_overview(spark, sf_dir):
    o = wiki.overview(pages(spark, sf_dir))
    part = lambda k: o[k].select(F.lit(k).alias("kind"), "project", "title")
    return part("recent").unionByName(part("top_hits")).unionByName(part("important"))


ENDS = "en AS (SELECT arg_min(title, doc_id) AS a, arg_max(title, doc_id) AS z FROM p WHERE project = 'src1')"


def _ends(p) -> tuple[str, str]:
    """The first and the last page of a project."""
    r = p.filter("project = 'src1'").agg(F.min_by("title", "doc_id").alias("a"), F.max_by("title", "doc_id").alias("z")).first()
    return r["a"], r["z"]


@query(f", {PAGES}, {ENDS} SELECT title, CASE WHEN project = 'src1' AND title = a THEN z WHEN project = 'src1' AND title = z THEN a ELSE '' END AS related, sha256(CASE WHEN project = 'src1' AND title IN (a, z) THEN body || chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || '- [[' || CASE title WHEN a THEN z ELSE a END || ']]' || chr(10) ELSE body END) AS h FROM p, en")
def linked_pages(spark, sf_dir):
    p = pages(spark, sf_dir)
    a, z = _ends(p)
    return wiki.link(p, "src1", a, z).select("title", F.array_join("related", ",").alias("related"), F.sha2("body", 256).alias("h"))


@query(f", {PAGES}, {ENDS} SELECT title, sha256(CASE WHEN at THEN body || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'more' ELSE body END) AS h, array_to_string(CASE WHEN at THEN list_append(tags, 'merged') ELSE tags END, ',') AS tags, CASE WHEN at THEN 'elsewhere' ELSE '' END AS sources, CAST(c4 + CAST(at AS INT) AS BIGINT) AS merge_count FROM (SELECT *, project = 'src1' AND title = a AS at FROM p, en)".replace(" AS at", " AS hit").replace("WHEN at ", "WHEN hit ").replace("CAST(at AS", "CAST(hit AS"))
def merged_page(spark, sf_dir):
    p = pages(spark, sf_dir)
    out = wiki.merge_into(p, "src1", _ends(p)[0], "more", ["merged"], "elsewhere")
    return out.select("title", F.sha2("body", 256).alias("h"), F.array_join("tags", ",").alias("tags"), F.array_join("sources", ",").alias("sources"), F.col("merge_count").cast("long").alias("merge_count"))


@query(f", {PAGES}, {ENDS} SELECT title, sha256(CASE WHEN project = 'src1' AND title = z THEN body || chr(10) || chr(10) || 'more' ELSE body END) AS h, CAST(c1 + CASE WHEN project = 'src1' AND title = z THEN 1 ELSE 0 END AS BIGINT) AS append_count FROM p, en WHERE NOT (project = 'src1' AND title = a)")
def updated_pages(spark, sf_dir):
    p = pages(spark, sf_dir)
    a, z = _ends(p)
    out = wiki.remove(wiki.update(p, "src1", z, append="more"), "src1", a)
    return out.select("title", F.sha2("body", 256).alias("h"), F.col("append_count").cast("long").alias("append_count"))


@query(f""", {PAGES}, {ENDS} SELECT title, CAST(c0 + 2 * c1 + c2 + c3 + 3 * c4 AS BIGINT) AS importance, (SELECT count(*) FROM (SELECT DISTINCT project, title, unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)) AS t FROM p) x WHERE x.t = p.title AND NOT (x.title = p.title AND x.project = p.project)) AS linked_from
FROM p, en WHERE project = 'src1' AND title = a""")
def page_details(spark, sf_dir):
    p = pages(spark, sf_dir)
    return wiki.page_detail(p, "src1", _ends(p)[0]).select("title", F.col("importance").cast("long").alias("importance"), "linked_from")


@query(f""", {PAGES}, fl AS (SELECT title, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['untagged'] END) AS tag, regexp_extract(body, '(?m)^\\s*([^\\s#].*)$', 1) AS f FROM p WHERE project = 'src1' AND NOT starts_with(title, '_')),
it AS (SELECT tag, title, '- [[' || title || ']]' || CASE WHEN f <> '' THEN ' - ' || CASE WHEN length(f) > 60 THEN substr(f, 1, 60) || '...' ELSE f END ELSE '' END AS item FROM fl),
gr AS (SELECT tag, string_agg(item, chr(10) ORDER BY title, item) AS list FROM it GROUP BY tag)
SELECT sha256('# src1' || chr(10) || chr(10) || string_agg('## ' || tag || chr(10) || chr(10) || list, chr(10) || chr(10) ORDER BY tag) || chr(10)) AS h FROM gr""")
def project_index(spark, sf_dir):
    return wiki.index_page(pages(spark, sf_dir), "src1").select(F.sha2("page", 256).alias("h"))


# --- requests


@query(f", {CANON} SELECT pages.page_id, round((row_number() OVER (PARTITION BY lower(regexp_extract(pages.url, '^[a-zA-Z]+://([^/:?#]+)', 1)) ORDER BY pages.page_id) - 1) / 2.0, 6) AS second FROM pages")
def request_times(spark, sf_dir):
    """A host sees two requests a second at most."""
    return topic.due(table(spark, sf_dir, "pages"), 2.0).select("page_id", F.round("at", 6).alias("second"))


@query(f", {CANON}, ca AS (SELECT cu.url, max(sha256(html)) AS tag FROM cu JOIN pages USING (page_id) WHERE page_id % 2 = 0 GROUP BY 1) SELECT cu.page_id, ca.tag AS if_none_match FROM cu LEFT JOIN ca ON ca.url = cu.url")
def conditional_requests(spark, sf_dir):
    """Pages of which a copy is held are asked for by its tag."""
    p = table(spark, sf_dir, "pages").withColumn("canonical_url", T.canonical_url(F.col("url")))
    cache = p.filter("page_id % 2 = 0").select("canonical_url", F.sha2("html", 256).alias("etag"), F.lit("2026").alias("last_modified"))
    return topic.conditional(p.select("page_id", "canonical_url"), cache).select("page_id", "if_none_match")


@query("SELECT page_id, url, 'seed' AS via FROM pages WHERE url IN (SELECT min(url) FROM pages UNION SELECT max(url) FROM pages)")
def seed_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    ends = p.agg(F.min("url").alias("a"), F.max("url").alias("z")).first()
    return research.seeds(spark, sorted({ends["a"], ends["z"]})).join(p.select("page_id", "url"), "url").select("page_id", "url", "via")


# --- streams, names, results


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, s FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s) WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > (SELECT count(*) / count(DISTINCT user_id) FROM events)) GROUP BY user_id")
def new_sessions(spark, sf_dir):
    """Sessions that went quiet, without those of users who had more events than most."""
    e = table(spark, sf_dir, "events")
    mean = e.agg((F.count("*") / F.count_distinct("user_id")).alias("m")).first()["m"]
    done = e.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > mean)
    return idle.only_new(idle.ready_sessions(e), done, "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("""SELECT doc_id, docid AS name, true AS is_id FROM d""")
def docid_names(spark, sf_dir):
    """Short ids as they are typed, with quotes, a sign and capitals."""
    typed = F.concat(F.lit(' "#'), F.upper("docid"), F.lit('" '))
    return documents(spark, sf_dir).select("doc_id", F.lower(T.normalise_docid(typed)).alias("name"), T.is_docid(typed).alias("is_id"))


XML = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(f"""SELECT doc_id + 1 AS rank, sha256('<file docid="' || docid || '" file="' || {XML('path')} || '" title="' || {XML('title')} || '">' || chr(10) || {XML('body')} || chr(10) || '</file>') AS h FROM d""")
def format_xml(spark, sf_dir):
    rows = documents(spark, sf_dir).select((F.col("doc_id") + 1).alias("rank"), "docid", "title", F.col("path").alias("file"), F.col("body").alias("snippet"))
    return formatter.as_xml(rows).select("rank", F.sha2("line", 256).alias("h"))
