"""Every query of the search and knowledge operators by name, with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunk, context, evaluate, expansion, formatter, fusion, health, index, knowledge, lookup, research, snippet, vector, wiki
from siltstone.plans import search
from siltstone.sources import sessions
from siltstone.streaming import idle

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {COMMON}\n{sql}"
        return f

    return add


TITLE = r"coalesce(nullif(trim(regexp_extract(text, '(?m)^##?\s+(.+)$', 1)), ''), CAST(doc_id AS VARCHAR))"
COMMON = rf"""d AS (
  SELECT doc_id, source AS collection, lang || '/' || doc_id || '.md' AS path, source || '/' || lang || '/' || doc_id || '.md' AS filepath,
    'vault://' || source || '/' || lang || '/' || doc_id || '.md' AS id, sha256(text) AS hash, substr(sha256(text), 1, 6) AS docid, {TITLE} AS title, text AS body,
    '2026-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS modified_at FROM documents
), k AS (
  SELECT id, collection, regexp_extract_all(lower(filepath), '[\p{{L}}\p{{N}}]+') AS f, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+') AS t, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS b FROM d
), v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), q AS (SELECT e AS qe FROM v WHERE vec_id = 0
), near AS (
  SELECT vec_id, label, 1 - list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS dist FROM v, q
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as an index's documents: its source is the collection, language and id make the path."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit(".md"))
    h = T.content_hash(F.col("text"))
    day = F.concat(F.lit("2026-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
    return d.select("doc_id", T.virtual_path(F.col("source"), path).alias("id"), F.col("source").alias("collection"), path.alias("path"), F.concat_ws("/", "source", path).alias("filepath"), T.title(F.col("text"), path).alias("title"), h.alias("hash"), T.docid(h).alias("docid"), F.col("text").alias("body"), F.lit("docs").alias("source_type"), F.lit(True).alias("active"), day.alias("modified_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("hash_seq"), "label", "embedding")


def stored(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    """Hashes of the texts that have a vector: those of the documents whose id a vector has."""
    return d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("hash")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def roots(spark: SparkSession) -> DataFrame:
    rows = [("src0", "/data/a", {"/": "all of a", "en": "English"}, True), ("src1", "/data/a/b/", {"fr": "French", "fr/1": "first French"}, None), ("src2", "/data/ab", {}, False), ("gone", "/srv/x", None, True)]
    return spark.createDataFrame(rows, "name string, root string, context map<string,string>, include_by_default boolean")


def lexical_index(spark: SparkSession, sf_dir: str) -> search.Index:
    return search.Index(documents(spark, sf_dir))


# --- store, status, health

@query("SELECT hash, count(*) AS copies, min(path) AS first_path FROM d GROUP BY hash")
def content_store(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path"))


@query("SELECT doc_id, title, docid FROM d")
def titles_and_docids(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "title", "docid")


@query("SELECT collection, count(*) AS documents, max(modified_at) AS last_modified FROM d GROUP BY collection")
def collection_status(spark, sf_dir):
    return health.status(documents(spark, sf_dir))


@query("SELECT name, coalesce(n, 0) AS total, coalesce(n, 0) AS active, m AS last_modified FROM (VALUES ('src0'), ('src1'), ('src2'), ('gone')) c(name) LEFT JOIN (SELECT collection, count(*) n, max(modified_at) m FROM d GROUP BY 1) ON name = collection")
def collection_stats(spark, sf_dir):
    return health.collection_stats(roots(spark), documents(spark, sf_dir))


@query("SELECT hash, min(path) AS path FROM d WHERE hash NOT IN (SELECT hash FROM d SEMI JOIN embeddings ON doc_id = vec_id) GROUP BY hash")
def pending_embeddings(spark, sf_dir):
    d = documents(spark, sf_dir)
    return vector.pending(d, stored(spark, sf_dir, d).select("hash", F.lit(0).alias("seq")))


@query("SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(DISTINCT hash) FROM d WHERE hash NOT IN (SELECT hash FROM d SEMI JOIN embeddings ON doc_id = vec_id)) AS needs_embedding, CAST(floor(date_diff('second', max(CAST(modified_at AS TIMESTAMP)), TIMESTAMP '2026-03-01 12:00:00') / 86400) AS BIGINT) AS days_stale FROM d")
def index_health(spark, sf_dir):
    d = documents(spark, sf_dir)
    return health.index_health(d, stored(spark, sf_dir, d), "2026-03-01T12:00:00Z")


@query("SELECT hash, doc_id FROM d WHERE hash NOT IN (SELECT hash FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def orphan_vectors(spark, sf_dir):
    d = documents(spark, sf_dir)
    return health.orphan_vectors(d.select("hash", "doc_id"), d.join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_anti"))


#: A collection for each source and, below it, for each of its languages.
NESTED = "nc AS (SELECT source AS name, '/data/' || source AS root FROM documents GROUP BY 1 UNION ALL SELECT source || '-' || lang, '/data/' || source || '/' || lang FROM documents GROUP BY source, lang)"


def nested(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    low = d.select(F.concat_ws("-", "source", "lang").alias("name"), F.concat(F.lit("/data/"), "source", F.lit("/"), "lang").alias("root"), "lang").distinct()
    top = d.select(F.col("source").alias("name"), F.concat(F.lit("/data/"), "source").alias("root"), F.lit(None).cast("string").alias("lang")).distinct()
    context = F.when(F.col("lang").isNotNull(), F.create_map(F.lit("/"), "lang")).otherwise(F.create_map(F.lit("en"), F.lit("English"), F.lit("fr/1"), F.lit("first French")))
    return top.unionByName(low).select("name", "root", context.alias("context"), F.lit(True).alias("include_by_default"))


@query(f", {NESTED} SELECT least(a.name, b.name) AS name_a, greatest(a.name, b.name) AS name_b FROM nc a JOIN nc b ON a.name <> b.name AND starts_with(b.root || '/', a.root || '/')")
def overlapping_collections(spark, sf_dir):
    return health.overlaps(nested(spark, sf_dir))


@query("""SELECT 'overlap' AS kind, 'src0,src1' AS subject UNION ALL VALUES ('no_context', 'src2'), ('no_context', 'gone'), ('empty', 'gone')
UNION ALL SELECT DISTINCT 'no_embedding', collection FROM d WHERE hash NOT IN (SELECT hash FROM d SEMI JOIN embeddings ON doc_id = vec_id)
UNION ALL SELECT 'stale', c FROM (SELECT collection AS c, max(CAST(modified_at AS TIMESTAMP)) AS m FROM d WHERE collection IN ('src0', 'src1', 'src2') GROUP BY 1) WHERE m < TIMESTAMP '2026-02-26 00:00:00' - INTERVAL 30 DAY""")
def health_alerts(spark, sf_dir):
    d = documents(spark, sf_dir)
    return health.alerts(roots(spark), d, stored(spark, sf_dir, d), "2026-02-26T00:00:00Z")


@query("""SELECT collection, path, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 = 1 THEN 'updated' WHEN doc_id % 10 = 2 THEN 'retitled' WHEN doc_id % 10 = 3 THEN 'removed' ELSE 'unchanged' END AS state FROM d""")
def snapshot_diff(spark, sf_dir):
    d = documents(spark, sf_dir)
    k = F.col("doc_id") % 10
    old = d.filter(k != 0).withColumn("hash", F.when(k == 1, "x").otherwise(F.col("hash"))).withColumn("title", F.when(k == 2, "old").otherwise(F.col("title")))
    return index.diff(old, d.filter(k != 3)).select("collection", "path", "state")


@query("SELECT collection, path, doc_id % 10 <> 3 AS active FROM d")
def snapshot_merge(spark, sf_dir):
    d = documents(spark, sf_dir)
    return index.merge(d.filter("doc_id % 10 <> 0"), d.filter("doc_id % 10 <> 3")).select("collection", "path", "active")


@query("SELECT CASE WHEN collection = 'src1' THEN 'renamed' ELSE collection END AS collection, count(*) AS n FROM d WHERE collection <> 'src2' GROUP BY 1")
def collection_rename_remove(spark, sf_dir):
    d = health.remove_collection(health.rename_collection(documents(spark, sf_dir), "src1", "renamed"), "src2")
    return health.drop_inactive(d).groupBy("collection").agg(F.count("*").alias("n"))


# --- lookup

@query("SELECT path, collection FROM d WHERE hash LIKE (SELECT docid FROM d WHERE doc_id = 7) || '%' ORDER BY collection, path LIMIT 1")
def docid_lookup(spark, sf_dir):
    d = documents(spark, sf_dir)
    wanted = d.filter("doc_id = 7").first()["docid"]
    return lookup.by_docid(d, f'"#{wanted.upper()}"').select("path", "collection")


@query(r"SELECT collection, path FROM d WHERE regexp_matches(path, '^(en|fr)/1[0-9]*[.]md$')")
def glob_match(spark, sf_dir):
    return lookup.match_glob(documents(spark, sf_dir), "{en,fr}/1*.md").select("collection", "path")


@query("SELECT collection, path, 12 AS line FROM d WHERE collection || '/' || path LIKE '%/17.md' ORDER BY collection, path LIMIT 1")
def suffix_lookup(spark, sf_dir):
    return lookup.find(documents(spark, sf_dir), "/17.md:12").select("collection", "path", "line")


@query("SELECT path, levenshtein(lower(path), 'en/12.md') AS distance FROM (SELECT DISTINCT path FROM d) WHERE levenshtein(lower(path), 'en/12.md') <= 3 ORDER BY distance, path LIMIT 5")
def similar_paths(spark, sf_dir):
    return lookup.similar(documents(spark, sf_dir), "EN/12.md").select("path", F.col("distance").cast("long").alias("distance"))


@query("SELECT collection, path, title, docid FROM d WHERE collection = 'src3' AND starts_with(path, 'en/')")
def list_files(spark, sf_dir):
    return lookup.list_files(documents(spark, sf_dir), "src3", "en/")


@query("SELECT name, path, CASE WHEN octet_length(encode(body)) > 10240 THEN NULL ELSE sha256(body) END AS body_hash FROM (SELECT n AS name, path, body, row_number() OVER (PARTITION BY n ORDER BY filepath) AS r FROM d JOIN (VALUES ('/3.md'), ('/4.md'), ('/5.md')) w(n) ON filepath LIKE '%' || n) WHERE r = 1")
def multi_lookup(spark, sf_dir):
    found, _ = lookup.find_many(documents(spark, sf_dir), "/3.md, /4.md, /5.md, nowhere.md")
    return found.select("name", "path", F.sha2("body", 256).alias("body_hash"))


@query("SELECT name FROM (VALUES ('src0'), ('src1'), ('gone')) c(name) UNION SELECT DISTINCT collection FROM d WHERE collection NOT IN ('src0', 'src1', 'src2', 'gone')")
def default_collections(spark, sf_dir):
    return lookup.default_collections(roots(spark), documents(spark, sf_dir))


@query(r"SELECT doc_id, array_to_string(string_split(body, chr(10))[2:3], chr(10)) AS slice FROM d")
def body_slice(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.line_slice(F.col("body"), 2, 2).alias("slice"))


@query("SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(l) + 1), lambda i: CAST(i AS VARCHAR) || ': ' || l[i]), chr(10))) AS h FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM d)")
def line_numbers(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(T.numbered(F.col("body")), 256).alias("h"))


# --- context

CONTEXTS = "(VALUES ('src0', '', 'all of a'), ('src0', 'en', 'English'), ('src1', 'fr', 'French'), ('src1', 'fr/1', 'first French')) c(c, p, x)"


@query(f"SELECT d.collection, d.path, concat_ws(chr(10) || chr(10), 'everything', string_agg(x, chr(10) || chr(10) ORDER BY length(p), x)) AS context FROM d LEFT JOIN {CONTEXTS} ON c = d.collection AND starts_with(d.path, p) GROUP BY 1, 2")
def context_all(spark, sf_dir):
    return context.all_contexts(documents(spark, sf_dir), context.entries(roots(spark)), "everything")


@query(f"SELECT collection, path, x AS context FROM (SELECT d.collection, d.path, x, row_number() OVER (PARTITION BY d.collection, d.path ORDER BY length(p) DESC) AS r FROM d JOIN {CONTEXTS} ON c = d.collection AND starts_with(d.path, p)) WHERE r = 1")
def context_longest(spark, sf_dir):
    return context.longest_context(documents(spark, sf_dir), context.entries(roots(spark)))


@query("SELECT name, CASE WHEN name = 'src2' THEN (SELECT count(*) FROM d WHERE collection = 'src2') ELSE 0 END AS documents FROM (VALUES ('src2'), ('gone')) c(name)")
def collections_without_context(spark, sf_dir):
    return context.without_context(roots(spark), documents(spark, sf_dir))


@query("SELECT DISTINCT collection, split_part(path, '/', 1) AS folder FROM d WHERE (collection, split_part(path, '/', 1)) NOT IN (VALUES ('src0', 'en'), ('src1', 'fr'))")
def folders_without_context(spark, sf_dir):
    return context.folders_without_context(documents(spark, sf_dir), context.entries(roots(spark)))


# --- lexical search

@query("SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(list_concat(f, list_concat(t, b))) AS term FROM k) GROUP BY 1, 2) GROUP BY term")
def vocabulary(spark, sf_dir):
    return index.vocabulary_of(documents(spark, sf_dir))


def _bm25_sql(clauses: list[tuple[str, bool]], tail: str) -> str:
    """The ranking for clauses (condition on a list's x at i, negated)."""
    hits = lambda c, l: f"len(list_filter(range(1, len({l}) + 1), lambda i: {c.replace('$', l)}))"
    cols = ", ".join(f"1.5 * {hits(c, 'f')} + 4.0 * {hits(c, 't')} + 1.0 * {hits(c, 'b')} AS tf{i}" for i, (c, _) in enumerate(clauses))
    pos = [i for i, (_, no) in enumerate(clauses) if not no]
    part = " + ".join(f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in pos)
    where = " AND ".join([f"tf{i} {'=' if no else '>'} 0" for i, (_, no) in enumerate(clauses)])
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) OVER () AS df{i}" for i in pos)
    return f""", h AS (SELECT id, collection, len(f) + len(t) + len(b) AS len, {cols} FROM k), s AS (SELECT *, count(*) OVER () AS n, avg(len) OVER () AS mean, {dfs} FROM h),
r AS (SELECT id, collection, {part} AS bm FROM s WHERE {where})
{tail}"""


SCORED = "round(bm / (1 + bm), 6) AS score"


@query(_bm25_sql([("starts_with($[i], 'the')", False), ("starts_with($[i], 'tion')", False)], f"SELECT id, {SCORED} FROM r ORDER BY bm DESC, id LIMIT 20"))
def bm25_prefixes(spark, sf_dir):
    return lexical_index(spark, sf_dir).lexical("the tion").select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql([("$[i] = 'of' AND $[i + 1] = 'the'", False), ("starts_with($[i], 'and')", False)], f"SELECT id, {SCORED} FROM r ORDER BY bm DESC, id LIMIT 20"))
def bm25_phrase(spark, sf_dir):
    return lexical_index(spark, sf_dir).lexical('"of the" and').select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql([("starts_with($[i], 'that')", False), ("starts_with($[i], 'with')", True)], f"SELECT id, {SCORED} FROM r ORDER BY bm DESC, id LIMIT 20"))
def bm25_negation(spark, sf_dir):
    return lexical_index(spark, sf_dir).lexical("that -with").select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql([("starts_with($[i], 'for')", False)], f"SELECT id, {SCORED} FROM (SELECT * FROM r ORDER BY bm DESC, id LIMIT 50) WHERE collection = 'src1' ORDER BY bm DESC, id LIMIT 5"))
def bm25_collection_overfetch(spark, sf_dir):
    return lexical_index(spark, sf_dir).lexical("for", 5, "src1").select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql([("starts_with($[i], 'for')", False)], f"SELECT id, {SCORED} FROM r WHERE collection = 'src1' ORDER BY bm DESC, id LIMIT 5"))
def bm25_collection_exact(spark, sf_dir):
    return lexical_index(spark, sf_dir).lexical("for", 5, "src1", exact=True).select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql([("$[i] = 'src1' AND $[i + 1] = 'es'", False)], f"SELECT id, {SCORED} FROM r ORDER BY bm DESC, id LIMIT 20"))
def bm25_hyphened(spark, sf_dir):
    return lexical_index(spark, sf_dir).lexical("src1-es").select("id", F.round("score", 6).alias("score"))


@query(_bm25_sql([("starts_with($[i], 'the')", False), ("starts_with($[i], 'tion')", False)], "SELECT id AS file, round(1.0 / row_number() OVER (ORDER BY bm DESC, id), 6) AS score FROM r ORDER BY bm DESC, id LIMIT 10"))
def hybrid_skip_rerank(spark, sf_dir):
    return search.hybrid(lexical_index(spark, sf_dir), "the tion").select("file", F.round("score", 6).alias("score"))


# --- vectors

@query("SELECT vec_id, round(dist, 6) AS distance FROM near ORDER BY dist, CAST(vec_id AS VARCHAR) LIMIT 25")
def vector_nearest(spark, sf_dir):
    return vector.nearest(vectors(spark, sf_dir), query_vector(spark, sf_dir), 25).select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT 'label' || label AS id, round(min(1 - dist), 6) * 0 + round(max(1 - dist), 6) AS score FROM (SELECT * FROM near ORDER BY dist, CAST(vec_id AS VARCHAR) LIMIT 30) GROUP BY label ORDER BY max(1 - dist) DESC LIMIT 10")
def vector_best_per_file(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.concat(F.lit("label"), F.col("label")).alias("hash"), F.lit(0).alias("seq"), F.lit(0).alias("pos"), "hash_seq", "embedding")
    files = v.select(F.col("hash").alias("id"), "hash", F.lit(True).alias("active")).distinct()
    return vector.search(v, files, query_vector(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


@query("SELECT qid, vec_id, rank FROM (SELECT a.vec_id AS qid, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_dot_product(b.e, a.e) / (sqrt(list_dot_product(b.e, b.e)) * sqrt(list_dot_product(a.e, a.e))), CAST(b.vec_id AS VARCHAR)) AS rank FROM v a, v b WHERE a.vec_id % 100 = 0) WHERE rank <= 7")
def vector_nearest_of_many(spark, sf_dir):
    """Every vector whose id is divisible by 100 against all."""
    v = vectors(spark, sf_dir)
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return vector.nearest_of_many(v, q, 7).select("qid", F.col("hash_seq").cast("long").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


# --- fusion

LISTS = "l AS (SELECT 0 AS list, id AS file, CAST(length(body) AS DOUBLE) AS score FROM d UNION ALL SELECT 1, id, CAST(length(body) - length(replace(body, 'e', '')) AS DOUBLE) FROM d), rk AS (SELECT list, file, row_number() OVER (PARTITION BY list ORDER BY score DESC, file) AS rank, CASE WHEN list = 0 THEN 2.0 ELSE 1.0 END AS w FROM l), fu AS (SELECT file, sum(w / (60 + rank)) + CASE WHEN min(rank) = 1 THEN 0.05 WHEN min(rank) <= 3 THEN 0.02 ELSE 0 END AS rrf, min(rank) AS best_rank, count(*) AS lists FROM rk GROUP BY file)"


def ranked_lists(spark, sf_dir):
    d = documents(spark, sf_dir)
    a = d.select(F.lit(0).alias("list"), F.col("id").alias("file"), F.length("body").cast("double").alias("score"))
    b = d.select(F.lit(1).alias("list"), F.col("id").alias("file"), (F.length("body") - F.length(F.replace("body", F.lit("e"), F.lit("")))).cast("double").alias("score"))
    return fusion.rank_lists(a.unionByName(b))


@query(f", {LISTS} SELECT file, round(rrf, 9) AS rrf, best_rank FROM fu")
def rrf_fusion(spark, sf_dir):
    return fusion.fuse(ranked_lists(spark, sf_dir), {0: 2.0, 1: 1.0}).select("file", F.round("rrf", 9).alias("rrf"), F.col("best_rank").cast("long").alias("best_rank"))


@query(f", {LISTS} SELECT file, round(rrf, 9) AS total, lists FROM fu")
def rrf_trace(spark, sf_dir):
    return fusion.trace(ranked_lists(spark, sf_dir), {0: 2.0, 1: 1.0}).select("file", F.round("total", 9).alias("total"), F.size("contributions").cast("long").alias("lists"))


@query(f", {LISTS}, c AS (SELECT file, best_rank, row_number() OVER (ORDER BY rrf DESC, file) AS place FROM fu ORDER BY rrf DESC, file LIMIT 40) SELECT file, round(w / place + (1 - w) / (1.0 + best_rank), 9) AS score FROM (SELECT *, CASE WHEN place <= 3 THEN 0.75 WHEN place <= 10 THEN 0.6 ELSE 0.4 END AS w FROM c) ORDER BY w / place + (1 - w) / (1.0 + best_rank) DESC, file LIMIT 10")
def position_blend(spark, sf_dir):
    c = fusion.candidates(fusion.fuse(ranked_lists(spark, sf_dir), {0: 2.0, 1: 1.0})).withColumn("rerank", 1 / (1 + F.col("best_rank")))
    return fusion.finish(fusion.blend(c), 10).select("file", F.round("score", 9).alias("score"))


# --- chunks and snippets

#: The chunks as a recursion: every break begins with a line's end, so lines with their offsets give all break points and scores; a break with an odd number of fences before it is inside one.
CHUNKS = r"""ln AS (SELECT id, length(body) AS n, generate_subscripts(l, 1) AS i, len(l) AS lines, unnest(l) AS x FROM (SELECT id, body, string_split(body, chr(10)) AS l FROM d)),
lo AS (SELECT *, lag(x) OVER w AS before, coalesce(sum(length(x) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS p FROM ln WINDOW w AS (PARTITION BY id ORDER BY i)),
bs AS (SELECT id, i, p, starts_with(x, '```') AS fence, CASE WHEN regexp_matches(x, '^#([^#]|$)') THEN 100 WHEN regexp_matches(x, '^##([^#]|$)') THEN 90 WHEN regexp_matches(x, '^###([^#]|$)') OR starts_with(x, '```') THEN 80
  WHEN regexp_matches(x, '^####([^#]|$)') THEN 70 WHEN regexp_matches(x, '^#####([^#]|$)') OR (regexp_matches(x, '^(---|[*][*][*]|___)\s*$') AND i < lines) THEN 60 WHEN regexp_matches(x, '^######([^#]|$)') THEN 50
  WHEN x = '' AND i < lines AND NOT (i > 2 AND before = '') THEN 20 WHEN regexp_matches(x, '^([-*]|[0-9]+[.])\s') OR (x IN ('-', '*') AND i < lines) OR (regexp_matches(x, '^[0-9]+[.]$') AND i < lines) THEN 5 ELSE 1 END AS s FROM lo WHERE i > 1),
bp AS (SELECT id, list({'p': p, 's': s} ORDER BY p) AS points FROM (SELECT *, coalesce(sum(CAST(fence AS INT)) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS inside FROM bs) WHERE inside = 0 GROUP BY id),
dn AS (SELECT d.id, body, length(body) AS n, points FROM d LEFT JOIN bp USING (id)),
ct AS (SELECT id, 0 AS seq, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS e FROM dn
  UNION ALL SELECT id, CASE WHEN e IS NULL THEN seq ELSE seq + 1 END, CASE WHEN e IS NULL THEN pos WHEN e - 540 > pos THEN e - 540 ELSE e END,
    CASE WHEN e IS NOT NULL THEN NULL WHEN n <= 3600 OR pos + 3600 >= n THEN n ELSE CASE WHEN cut_at > pos THEN cut_at ELSE pos + 3600 END END
  FROM (SELECT *, w[list_position(list_transform(w, lambda x: x.s * (1 - 0.7 * pow((pos + 3600 - x.p) / 800.0, 2))), list_max(list_transform(w, lambda x: x.s * (1 - 0.7 * pow((pos + 3600 - x.p) / 800.0, 2)))))].p AS cut_at
    FROM (SELECT ct.id, ct.seq, ct.pos, ct.e, n, list_filter(points, lambda x: x.p BETWEEN pos + 2800 AND pos + 3600) AS w FROM ct JOIN dn USING (id) WHERE e IS NULL OR e < n))),
ck AS (SELECT id, CAST(seq AS INTEGER) AS seq, CAST(pos AS INTEGER) AS pos, substr(body, pos + 1, e - pos) AS text FROM ct JOIN dn USING (id) WHERE e IS NOT NULL)"""


@query(f", {CHUNKS} SELECT id, seq, pos, text FROM ck")
def chunks(spark, sf_dir):
    return chunk.chunk_documents(documents(spark, sf_dir), "id", "body")


@query(f", {CHUNKS} SELECT id AS file, seq, pos, text FROM ck QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(contains(lower(text), 'that') AS INT) + CAST(contains(lower(text), 'tion') AS INT) DESC, seq) = 1")
def best_chunks(spark, sf_dir):
    cut = chunk.chunk_documents(documents(spark, sf_dir).withColumnRenamed("id", "file"), "file", "body")
    return fusion.best_chunk(cut, "that tion")


SNIP = "sn AS (SELECT doc_id, len(l) AS n, l, list_transform(l, lambda x: CAST(contains(lower(x), 'that') AS INT) + CAST(contains(lower(x), 'tion') AS INT)) AS s FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM d)), sb AS (SELECT *, list_position(s, list_max(s)) AS best FROM sn), sc AS (SELECT *, greatest(1, best - 1) AS first, array_to_string(l[greatest(1, best - 1) : best + 2], chr(10)) AS t, least(n, best + 2) - greatest(1, best - 1) + 1 AS c FROM sb)"


@query(f", {SNIP} SELECT doc_id, best AS line, '@@ -' || first || ',' || c || ' @@ (' || (first - 1) || ' before, ' || (n - first - c + 1) || ' after)' || chr(10) || CASE WHEN length(t) > 500 THEN substr(t, 1, 497) || '...' ELSE t END AS snippet FROM sc")
def snippets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", snippet.snippet(F.col("body"), "that tion").alias("s")).select("doc_id", F.col("s.line").cast("long").alias("line"), "s.snippet")


# --- results

@query(r"""SELECT rank, CASE WHEN regexp_matches(title, '[",\n\r]') THEN '"' || replace(title, '"', '""') || '"' ELSE title END || ',' || path AS line FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rank, title, path FROM d) UNION ALL SELECT 0, 'title,path'""")
def format_csv(spark, sf_dir):
    rows = documents(spark, sf_dir).select((F.col("doc_id") + 1).cast("int").alias("rank"), "title", "path")
    return formatter.as_csv(rows, ["title", "path"]).select(F.col("rank").cast("long").alias("rank"), "line")


@query("SELECT doc_id, sha256(replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS h FROM d")
def format_xml_escape(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(formatter.xml_escape(F.col("body")), 256).alias("h"))


@query("SELECT id, title FROM d ORDER BY title, id LIMIT 10 OFFSET 20")
def paging(spark, sf_dir):
    return documents(spark, sf_dir).select("id", "title").orderBy("title", "id").offset(20).limit(10)


# --- wiki

#: Pages of the documents: a page has the text, its language and first word as tags, and a link to the first document that begins with the same word; its counters are how often the text has each of some marks.
MARKS = ".,!?;:-"
FIRST_WORD = r"regexp_extract(lower(text), '[\p{L}\p{N}]+')"
PAGES = rf"""p AS (SELECT source AS project, CAST(doc_id AS VARCHAR) AS title, doc_id, text || chr(10) || '[[' || min(doc_id) OVER (PARTITION BY {FIRST_WORD}) || ']]' AS body, list_filter([lang, {FIRST_WORD}], lambda x: x <> '') AS tags,
  {', '.join(f"length(text) - length(replace(text, '{m}', '')) AS c{k}" for k, m in enumerate(MARKS))} FROM documents)"""


def pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    word = F.regexp_extract(F.lower("text"), r"[\p{L}\p{N}]+", 0)
    firsts = d.groupBy(word.alias("word")).agg(F.min("doc_id").alias("first"))
    none = F.array().cast("array<string>")
    many = lambda m: (F.length("text") - F.length(F.replace("text", F.lit(m), F.lit("")))).cast("int")
    rows = d.withColumn("word", word).join(firsts, "word")
    return rows.select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("title"), "doc_id", F.concat("text", F.lit("\n[["), "first", F.lit("]]")).alias("body"), F.filter(F.array("lang", "word"), lambda x: x != "").alias("tags"), none.alias("related"), none.alias("sources"), *[many(m).alias(c) for m, c in zip(MARKS, wiki.COUNTERS)], F.lit("2026-01-01").alias("updated"))


@query(f", {PAGES} SELECT tag, count(*) AS pages, array_to_string(list_sort(list_distinct(list(project))), ',') AS projects FROM (SELECT project, unnest(tags) AS tag FROM p) GROUP BY tag")
def tag_counts(spark, sf_dir):
    return health.tag_counts(pages(spark, sf_dir)).withColumn("projects", F.array_join("projects", ","))


@query(f", {PAGES}, e AS (SELECT DISTINCT project AS fp, title AS ft, unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1)) AS title FROM p) SELECT p.project, p.title, fp AS from_project, ft AS from_title FROM p JOIN e ON p.title = e.title WHERE p.title <> ft OR p.project <> fp")
def backlinks(spark, sf_dir):
    return wiki.backlinks(pages(spark, sf_dir))


@query(f", {PAGES} SELECT title, CAST(c0 + 2 * c1 + c2 + c3 + 3 * c4 AS BIGINT) AS importance, CAST(c5 + c6 AS BIGINT) AS hit_count FROM p")
def page_importance(spark, sf_dir):
    p = wiki.scored(pages(spark, sf_dir))
    return p.select("title", F.col("importance").cast("long").alias("importance"), F.col("hit_count").cast("long").alias("hit_count"))


@query("SELECT source AS project, count(*) AS pages FROM documents GROUP BY 1")
def project_counts(spark, sf_dir):
    return wiki.overview(pages(spark, sf_dir))["projects"]


@query(f", {PAGES} SELECT doc_id, title, project, array_to_string(tags, ',') AS tags, regexp_replace(body, '^\\n+', '') AS body FROM p")
def front_matter_round_trip(spark, sf_dir):
    t = wiki.render(pages(spark, sf_dir)).select("doc_id", wiki.front_matter(F.col("text")).alias("m"))
    return t.select("doc_id", "m.title", "m.project", F.array_join("m.tags", ",").alias("tags"), "m.body")


# --- sessions and knowledge

@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, sha256('---' || chr(10) || 'session_id: ' || conv_id || chr(10) || 'project: p' || chr(10) || 'start_time: a' || chr(10) || 'end_time: b' || chr(10) || 'parser_version: \"1.0\"' || chr(10) || '---' || string_agg(chr(10) || chr(10) || CASE role WHEN 'user' THEN '### User' WHEN 'assistant' THEN '### Assistant' ELSE '### Tool' END || chr(10) || text, '' ORDER BY turn) || chr(10)) AS h FROM conversations GROUP BY conv_id")
def session_markdown(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))
    s = c.select("session_id", F.lit("p").alias("project"), F.lit("a").alias("start_time"), F.lit("b").alias("end_time"), F.lit("1.0").alias("parser_version"), "messages")
    return sessions.to_markdown(s).select("session_id", F.sha2("markdown", 256).alias("h"))


@query("SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conversations")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("SELECT conv_id, turn FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM conversations) WHERE spent < 2000")
def within_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("cost", F.length("text"))
    return knowledge.within_budget(c, "cost", ["turn"], 2000, ["conv_id"]).select("conv_id", "turn")


@query("SELECT doc_id, '[Tool call: run] ' || doc_id AS t FROM documents")
def strip_tools(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("m", F.concat(F.lit("<details>\n<summary> run </summary>\n\n"), F.col("text"), F.lit("\n</details> "), F.col("doc_id").cast("string")))
    return d.select("doc_id", knowledge.strip_tools(F.col("m")).alias("t"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS \"end\", count(*) AS events FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s")
def idle_sessions(spark, sf_dir):
    out = idle.ready_sessions(table(spark, sf_dir, "events"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


# --- research

CANON = r"cu AS (SELECT page_id, scheme || '://' || host || CASE WHEN path IN ('', '/') THEN CASE WHEN kept = '' THEN '' ELSE '/' END ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS url FROM (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)) AS host, regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS path, array_to_string(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i)(?:utm_[^=&]*|fbclid|gclid|mc_[^=&]*|_hsenc|_hsmi|ref|ref_[^=&]*)(?:=|$)')), '&') AS kept FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages)))"


@query(f", {CANON} SELECT page_id, url, substr(sha256(url), 1, 12) AS id FROM cu")
def canonical_urls(spark, sf_dir):
    u = T.canonical_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("url"), T.source_id(u).alias("id"))


@query("SELECT doc_id, CASE WHEN n < 200 THEN 'too_short' WHEN n > 5000 THEN 'too_long' WHEN regexp_matches(substr(text, 1, 2000), '(?i)\\b(subscribe to read|paywall|sign up to continue|members only)\\b') THEN 'paywall' ELSE 'ok' END AS verdict FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)")
def quality_verdicts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.quality_verdict(F.col("text"), F.lit("https://a.example/x"), F.lit("en"), max_words=5000, languages=["en"]).alias("verdict"))


@query("SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body_hash, count(*) AS n FROM documents GROUP BY 1")
def body_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.body_hash(F.col("text")).alias("body_hash")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN c > 2 * l THEN 'ko' WHEN l > 5 AND c = 0 THEN 'en' WHEN c > 0 THEN 'ko' END AS language FROM (SELECT doc_id, len(regexp_extract_all(substr(text, 1, 1000), '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{ac00}-\\x{d7af}]')) AS c, len(regexp_extract_all(substr(text, 1, 1000), '[A-Za-z]')) AS l FROM documents)")
def language_guesses(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.language_guess(F.col("text")).alias("language"))


@query("SELECT DISTINCT page_id, regexp_replace(unnest(regexp_extract_all(html || ' see ' || url || '.', 'https?://[^\\s<>\"''\\])]+')), '[.,;:!?]+$', '') AS url FROM pages")
def urls_in_documents(spark, sf_dir):
    said = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit(" see "), "url", F.lit(".")).alias("text"))
    return research.urls_in(said, "page_id").distinct()


@query()
def extracted_pages(spark, sf_dir):
    return research.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "title", "canonical_url", "language", "word_count", "body_hash")


@query(rf""", {CANON}, pg AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS i, cu.url AS u, sha256(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS b FROM cu JOIN pages USING (page_id)),
st AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS page_id, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS bs, false AS accepted
  UNION ALL SELECT i, page_id, CASE WHEN ok THEN list_append(us, u) ELSE us END, CASE WHEN ok THEN list_append(bs, b) ELSE bs END, ok
  FROM (SELECT pg.i, pg.page_id, pg.u, pg.b, us, bs, NOT coalesce(list_contains(us, u), false) AND NOT coalesce(list_contains(bs, b), false) AS ok FROM st JOIN pg ON pg.i = st.i + 1))
SELECT page_id, accepted FROM st WHERE i > 0""")
def first_seen_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("canonical_url", T.canonical_url(F.col("url"))).withColumn("body_hash", T.body_hash(F.col("html")))
    return research.first_seen(p).select("page_id", "accepted")


@query("SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS n, sum(octet_length(encode(html))) OVER (ORDER BY page_id) AS b FROM pages) WHERE n <= 80 AND b <= 200000")
def fetch_budget(spark, sf_dir):
    return research.budgeted(table(spark, sf_dir, "pages").withColumnRenamed("html", "body_md"), 80, 200_000).select("page_id")


# --- evaluation

@query(f", {LISTS}, res AS (SELECT list AS query_id, rank, file FROM rk), ex AS (SELECT 0 AS query_id, id AS file FROM d JOIN labels USING (doc_id) WHERE quality = 0 UNION ALL SELECT 1, id FROM d JOIN labels USING (doc_id) WHERE toxic = 1), m AS (SELECT ex.query_id, ex.file, min(rank) AS r FROM ex LEFT JOIN res ON res.query_id = ex.query_id AND res.file = ex.file GROUP BY 1, 2), a AS (SELECT query_id, count(*) AS n, count(r) AS f, count(*) FILTER (WHERE r <= 10) AS h, min(r) AS first FROM m GROUP BY 1) SELECT query_id, round(h / least(10, n), 9) AS precision_at_k, round(f / n, 9) AS recall, round(coalesce(1.0 / first, 0), 9) AS mrr, h AS hits_at_k FROM a")
def retrieval_metrics(spark, sf_dir):
    d = documents(spark, sf_dir)
    known = d.join(table(spark, sf_dir, "labels"), "doc_id")
    want = known.filter("quality = 0").select(F.lit(0).alias("query_id"), F.col("id").alias("file")).unionByName(known.filter("toxic = 1").select(F.lit(1).alias("query_id"), F.col("id").alias("file")))
    got = evaluate.retrieval(ranked_lists(spark, sf_dir).select(F.col("list").alias("query_id"), "rank", "file"), want, 10)
    return got.select("query_id", *[F.round(c, 9).alias(c) for c in ("precision_at_k", "recall", "mrr")], "hits_at_k")


@query("SELECT round(avg(n_chars % 101), 6) AS mean, round(median(n_chars % 101), 6) AS median, min(n_chars % 101) AS least, max(n_chars % 101) AS most, round(avg(CASE WHEN n_chars % 101 >= 70 THEN 1.0 ELSE 0.0 END), 6) AS share_70 FROM documents")
def reward_profile(spark, sf_dir):
    out = evaluate.reward_profile(table(spark, sf_dir, "documents").withColumn("percentage", F.col("n_chars") % 101))
    return out.select(F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "least", "most", F.round("share_70", 6).alias("share_70"))


@query("SELECT CASE WHEN p >= 80 THEN 'Excellent' WHEN p >= 60 THEN 'Good' WHEN p >= 40 THEN 'Acceptable' WHEN p >= 20 THEN 'Poor' ELSE 'Failed' END AS rating, count(*) AS n FROM (SELECT n_chars % 101 AS p FROM documents) GROUP BY 1")
def reward_bands(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(evaluate.rating(F.col("n_chars") % 101).alias("rating")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS q, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) = 1")
def expansion_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.col("text").alias("query"), "doc_id")
    return expansion.dedup(p, ["doc_id"]).select(F.sha2("query", 256).alias("q"), "doc_id")


# --- further operators

@query("SELECT collection, CASE WHEN doc_id % 2 = 0 THEN path ELSE upper(path) END AS path FROM d")
def case_renames(spark, sf_dir):
    d = documents(spark, sf_dir)
    new = d.withColumn("path", F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.upper("path")))
    return index.rename_case(d, new).select("collection", "path")


@query("SELECT hash, count(*) AS n FROM d WHERE doc_id % 5 <> 0 GROUP BY hash HAVING hash IN (SELECT hash FROM d WHERE doc_id % 7 = 0)")
def orphan_content(spark, sf_dir):
    d = documents(spark, sf_dir)
    return health.drop_orphan_content(d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 7 = 0")).groupBy("hash").agg(F.count("*").alias("n"))


@query("SELECT id AS hash, modified_at AS created_at FROM d ORDER BY modified_at DESC, id LIMIT 50")
def newest_cache_entries(spark, sf_dir):
    return health.trim_cache(documents(spark, sf_dir).select(F.col("id").alias("hash"), F.col("modified_at").alias("created_at")), 50)


@query("SELECT DISTINCT sha256(lower(trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(body), '[^\\p{L}\\p{N}\\s-]', '', 'g')), '[\\s-]+', '-', 'g'), '^-|-$', '', 'g')))) AS slug FROM d")
def slugs(spark, sf_dir):
    return documents(spark, sf_dir).select(F.sha2(T.slug(F.col("body")), 256).alias("slug")).distinct()


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a-' || doc_id || '/b-c.md' WHEN doc_id % 3 = 1 THEN 'x/' || doc_id || '.md' ELSE doc_id || '-v1.txt' END AS path FROM documents")
def clean_paths(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a "), n, F.lit("/b__c.md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x___"), n, F.lit("!.md"))).otherwise(F.concat(n, F.lit(".v1.txt")))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_path(raw).alias("path"))


@query("SELECT doc_id, 'src' || (doc_id % 3) AS collection, 'p/' || doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 'main' END AS index FROM documents")
def virtual_paths(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    name = F.concat(F.lit("vault:////src"), F.col("doc_id") % 3, F.lit("/p/"), n, F.lit(".md"), F.when(F.col("doc_id") % 2 == 0, "?index=main").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.parse_virtual(name).alias("v")).select("doc_id", "v.collection", "v.path", "v.index")


@query("SELECT doc_id, sha256('title: ' || title || ' | text: ' || body) AS document, sha256('task: search result | query: ' || title) AS query FROM d")
def embedding_prompts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(vector.prompt(F.col("body"), F.col("title")), 256).alias("document"), F.sha2(vector.prompt(F.col("title"), query=True), 256).alias("query"))


@query("SELECT doc_id + 1 AS rank, '#' || docid || ',0.50,' || path AS line FROM d")
def format_files(spark, sf_dir):
    rows = documents(spark, sf_dir).select((F.col("doc_id") + 1).alias("rank"), "docid", F.lit(0.5).alias("score"), F.col("path").alias("file"))
    return formatter.as_files(rows)


@query("SELECT doc_id + 1 AS rank, '---' || chr(10) || '# ' || title || chr(10) || chr(10) || '**docid:** `#' || docid || '`' || chr(10) || chr(10) || body || chr(10) AS line FROM d")
def format_markdown(spark, sf_dir):
    rows = documents(spark, sf_dir).select((F.col("doc_id") + 1).alias("rank"), "docid", "title", F.col("path").alias("file"), F.col("body").alias("snippet"))
    return formatter.as_markdown(rows)


@query("SELECT doc_id + 1 AS rank, '{\"docid\":\"' || docid || '\",\"file\":\"' || path || '\"}' AS line FROM d")
def format_json(spark, sf_dir):
    rows = documents(spark, sf_dir).select((F.col("doc_id") + 1).alias("rank"), "docid", F.col("path").alias("file"))
    return formatter.as_json(rows, ["docid", "file"])


@query("SELECT doc_id, 'n' || doc_id AS title, [('k' || doc_id % 3), 'z'][1] AS first_tag, 2 AS tags FROM documents WHERE doc_id % 2 = 0")
def notes_from_answers(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"title": "n'), n, F.lit('", "summary": "s", "tags": ["k'), F.col("doc_id") % 3, F.lit('", "z"]}'))
    answer = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 2 == 0, body).otherwise("no json")
    got = table(spark, sf_dir, "documents").select("doc_id", knowledge.parse_note(answer).alias("n")).filter("n is not null")
    return got.select("doc_id", "n.title", F.get("n.tags", F.lit(0)).alias("first_tag"), F.size("n.tags").alias("tags"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, string_agg(text, ' ' ORDER BY turn) AS summary, arg_min('t' || turn, turn) AS title, count(*) + 1 AS tags FROM conversations GROUP BY conv_id")
def merged_notes(spark, sf_dir):
    t = F.concat(F.lit("t"), F.col("turn").cast("string"))
    note = F.struct(t.alias("title"), F.col("text").alias("summary"), F.array().cast("array<string>").alias("keyInsights"), F.array(t, F.lit("all")).alias("tags"), F.array().cast("array<string>").alias("relatedTopics"))
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("part"), note.alias("note"))
    return knowledge.merge_notes(parts).select("session_id", "summary", "title", F.size("tags").cast("long").alias("tags"))


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id FROM conversations WHERE conv_id % 3 <> 0")
def unprocessed_sessions(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id")).distinct()
    return knowledge.unprocessed(s, s.withColumn("status", F.when(F.col("session_id").cast("long") % 3 == 0, "processed").otherwise("failed")))


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id FROM conversations GROUP BY conv_id HAVING count(*) < 4")
def retry_queue(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"))
    return knowledge.retry_queue(c.distinct(), c, 4)


@query("SELECT CAST(user_id % 5 AS VARCHAR) AS topic, count(*) FILTER (WHERE event_type = (SELECT min(event_type) FROM events)) AS fetched, round(sum(value), 4) AS cost, arg_max(event_id, event_id) AS last_event FROM events GROUP BY 1")
def topic_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type")).first()[0]
    rows = e.select((F.col("user_id") % 5).cast("string").alias("topic"), F.col("event_id").alias("ts"), F.when(F.col("event_type") == first, "fetched").otherwise(F.col("event_id").cast("string")).alias("kind"), F.col("value").alias("cost"), "event_id")
    got = research.run_status(rows).select("topic", "fetched", F.round("cost", 4).alias("cost"))
    return got.join(rows.groupBy("topic").agg(F.max("event_id").alias("last_event")), "topic")


@query("SELECT CASE WHEN n <= 2 THEN 'short' WHEN n <= 6 THEN 'medium' ELSE 'long' END AS band, lang AS category, count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS with_lex, count(*) AS with_vec, 0 AS with_hyde FROM (SELECT *, doc_id % 9 + 1 AS n FROM documents) GROUP BY 1, 2")
def training_profile(spark, sf_dir):
    q = F.array_join(F.array_repeat(F.lit("w"), (F.col("doc_id") % 9 + 1).cast("int")), " ")
    p = table(spark, sf_dir, "documents").select(q.alias("query"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("lex"), F.lit("vec"))).otherwise(F.array(F.lit("vec"))).alias("types"))
    return evaluate.dataset_profile(p)


@query("SELECT source AS file, count(*) AS lines, count(*) FILTER (WHERE doc_id % 4 <> 0) AS valid, count(*) FILTER (WHERE doc_id % 4 = 0) AS invalid FROM documents GROUP BY 1")
def training_validation(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 4 == 0, "bad").otherwise("lex")
    p = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.lit("q").alias("query"), F.array(F.array(kind, F.lit("x"))).alias("output"))
    return expansion.validation_counts(p)


@query("SELECT doc_id, 'hyde: h' || doc_id || chr(10) || 'lex: a b' || chr(10) || 'vec: c' AS text, true AS has_hyde FROM documents")
def training_lines(spark, sf_dir):
    raw = F.concat(F.lit("lex: a b\nnoise\n  vec:  c\nhyde: h"), F.col("doc_id").cast("string"), F.lit("\nlex:\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", expansion.parse_lines(raw).alias("t"))
    return d.select("doc_id", expansion.render_lines(expansion.hyde_first(F.col("t"))).alias("text"), expansion.has_type(F.col("t"), "hyde").alias("has_hyde"))


@query("""SELECT query, type, round(CASE WHEN np > 0 THEN mp / np ELSE 0 END, 9) AS precision, round(mg / ng, 9) AS recall FROM (
  SELECT query, type, count(*) AS np, count(*) FILTER (WHERE ok) AS mp, CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN 1 ELSE 0 END AS mg, 1 AS ng FROM (
    SELECT DISTINCT source AS query, 'vec' AS type, CASE WHEN doc_id % 2 = 0 THEN 'alpha beta gamma' ELSE 'delta epsilon' END AS p, doc_id % 2 = 0 AS ok FROM documents) GROUP BY 1, 2)""")
def expansion_matches(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = d.select(F.col("source").alias("query"), F.lit("vec").alias("type"), F.when(F.col("doc_id") % 2 == 0, "alpha beta gamma").otherwise("delta epsilon").alias("text"))
    g = d.select(F.col("source").alias("query"), F.lit("vec").alias("type"), F.lit("alpha beta").alias("text"))
    return evaluate.expansion_match(p, g).select("query", "type", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("SELECT 'b' || (doc_id % 3) AS backend, round(avg(doc_id % 10), 6) AS precision_at_k, round(avg(doc_id % 7), 6) AS recall, count(*) AS queries FROM documents GROUP BY 1")
def benchmark_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("b"), F.col("doc_id") % 3).alias("backend"), (F.col("doc_id") % 10).alias("precision_at_k"), (F.col("doc_id") % 7).alias("recall"), F.lit(0).alias("mrr"), F.lit(0).alias("f1"))
    return evaluate.summary(d).select("backend", F.round("precision_at_k", 6).alias("precision_at_k"), F.round("recall", 6).alias("recall"), "queries")


@query(f", {NESTED} SELECT name, prefix, context FROM (SELECT name, 'en' AS prefix, CASE WHEN name = 'src0' THEN 'changed' ELSE 'English' END AS context FROM nc WHERE NOT contains(name, '-') UNION ALL SELECT name, 'fr/1', 'first French' FROM nc WHERE NOT contains(name, '-') AND name <> 'src1' UNION ALL SELECT name, '/', split_part(name, '-', 2) FROM nc WHERE contains(name, '-'))")
def context_changes(spark, sf_dir):
    c = context.remove(context.put(nested(spark, sf_dir), "src0", "en", "changed"), "src1", "fr/1")
    return context.entries(c).select(F.col("collection").alias("name"), "prefix", "context")


@query(f", {PAGES} SELECT title, CAST(c3 + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS link_count FROM p")
def counter_bumps(spark, sf_dir):
    p = pages(spark, sf_dir)
    hits = p.filter("doc_id % 2 = 0").select("project", "title", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return wiki.bump(p, hits, "link_count").select("title", F.col("link_count").cast("long").alias("link_count"))


def _project_search(word: str) -> str:
    return f"(WITH {_bm25_sql([(f'''starts_with($[i], '{word}')''', False)], "SELECT id, bm / (1 + bm) AS s FROM r WHERE collection = 'src1' ORDER BY bm DESC, id LIMIT 20")[2:]})"


@query(f"SELECT id, round(sum(s), 6) AS score FROM (SELECT id, 2 * s AS s FROM {_project_search('for')} UNION ALL SELECT id, s FROM {_project_search('the')}) GROUP BY id ORDER BY sum(s) DESC, id LIMIT 5")
def similar_pages(spark, sf_dir):
    """A project's pages that are like a new one, by searches for its title and for its text."""
    i = lexical_index(spark, sf_dir)
    of = lambda text: i.lexical(text, 20, "src1", exact=True).select("id", "score")
    return wiki.similar_pages(of("for"), of("the")).select("id", F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lexical search over the whole index."""
    return bm25_prefixes(spark, sf_dir)


from siltstone.plans import catalog_models, catalog_more, catalog_sets, catalog_sources  # noqa: E402, F401  (its queries register themselves here)
