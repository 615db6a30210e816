"""More of the catalogue: searches with models, here fixed ones, and the score of expansions; each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions.analyzer import TypedQuery
from siltstone.operators import reward
from siltstone.plans import search
from siltstone.plans.catalog import CHUNKS, _bm25_sql, documents, lexical_index, query, table


def _lexical_list(word: str) -> str:
    return f"(WITH {_bm25_sql([(f'''starts_with($[i], '{word}')''', False)], 'SELECT id, bm AS s FROM r ORDER BY bm DESC, id LIMIT 20')[2:]})"


def _vector_list(of: int) -> str:
    """Files by their nearest text's distance to a stored vector: 60 texts, then 20 files."""
    return f"""(SELECT d.id, -min(dist) AS s FROM (SELECT vec_id, 1 - list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS dist FROM v, (SELECT e AS qe FROM v WHERE vec_id = {of}) ORDER BY dist, CAST(vec_id AS VARCHAR) LIMIT 60) n
JOIN d o ON o.doc_id = n.vec_id JOIN d ON d.hash = o.hash GROUP BY d.id ORDER BY min(dist), d.id LIMIT 20)"""


LISTS = " UNION ALL ".join(f"SELECT {i} AS list, id, s FROM {x}" for i, x in enumerate([_lexical_list("for"), _lexical_list("the"), _vector_list(0), _vector_list(1)]))
PLACED = f""", ls AS ({LISTS}), rk AS (SELECT list, id, row_number() OVER (PARTITION BY list ORDER BY s DESC, id) AS rank FROM ls),
fu AS (SELECT id AS file, sum(CASE WHEN list < 2 THEN 2.0 ELSE 1.0 END / (60 + rank)) + CASE WHEN min(rank) = 1 THEN 0.05 WHEN min(rank) <= 3 THEN 0.02 ELSE 0 END AS rrf FROM rk GROUP BY id),
pl AS (SELECT file, row_number() OVER (ORDER BY round(rrf, 12) DESC, file) AS place FROM fu ORDER BY place LIMIT 40)"""


def _with_models(spark, sf_dir, reranker):
    """A plain query with an expander and an embedder; the vector of a document is that of its number."""
    lexical = lexical_index(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    chunks = documents(spark, sf_dir).join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id").select("hash", F.lit(0).alias("seq"), F.lit(0).alias("pos"), F.col("doc_id").cast("string").alias("hash_seq"), "embedding")
    first = {r["vec_id"]: r["embedding"] for r in e.filter("vec_id in (0, 1)").select("vec_id", "embedding").collect()}
    index = search.Index(lexical.documents, chunks=chunks)
    typed = [TypedQuery("lex", "the", 1), TypedQuery("vec", "what is said", 2)]
    out = search.hybrid(index, "for", lambda _: typed, lambda texts: [first[i] for i in range(len(texts))], reranker)
    return out.select("file", F.round("score", 6).alias("score"))


@query(f"{PLACED} SELECT file, round(1.0 / place, 6) AS score FROM pl ORDER BY place LIMIT 10")
def hybrid_with_vectors(spark, sf_dir):
    return _with_models(spark, sf_dir, None)


BEST = f"bk AS (SELECT id, text FROM ck QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(contains(lower(text), 'for') AS INT) DESC, seq) = 1)"


@query(f"{PLACED}, {CHUNKS}, {BEST} SELECT file, round(s, 6) AS score FROM (SELECT file, share / place + (1 - share) * (length(text) / 3600.0) AS s FROM (SELECT *, CASE WHEN place <= 3 THEN 0.75 WHEN place <= 10 THEN 0.6 ELSE 0.4 END AS share FROM pl) JOIN bk ON bk.id = file) ORDER BY s DESC, file LIMIT 10")
def hybrid_with_reranker(spark, sf_dir):
    """The whole of it: expansions, vectors, best chunks, scores of those chunks (the longer the better), blend."""
    return _with_models(spark, sf_dir, lambda _, texts: [len(t) / 3600 for t in texts])


MAY_REPEAT = ", ".join(f"'{w}'" for w in reward.MAY_REPEAT)
EXPANDED = rf""", t AS (SELECT doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS h FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(h), '[\p{{L}}\p{{N}}_]+')) AS w FROM t),
c AS (SELECT doc_id, 2 * sum(greatest(n - 2, 0)) AS again FROM (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) > 2 AND w NOT IN ({MAY_REPEAT}) GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT doc_id, lang, length(h) AS n, 10 + CASE WHEN length(h) BETWEEN 50 AND 200 THEN 5 WHEN length(h) < 50 THEN 2 ELSE 0 END + greatest(0, 5 - coalesce(again, 0)) AS passage FROM t LEFT JOIN c USING (doc_id)),
s AS (SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 110 + passage WHEN 'de' THEN 65 + CASE WHEN n BETWEEN 50 AND 200 THEN 10 WHEN n BETWEEN 30 AND 300 THEN 5 ELSE 0 END ELSE 100 + passage END AS INTEGER) AS total, CASE lang WHEN 'de' THEN 120 ELSE 140 END AS max_points FROM p)"""


@query(f"{EXPANDED} SELECT doc_id, total, max_points, CASE WHEN 100.0 * total / max_points >= 80 THEN 'Excellent' WHEN 100.0 * total / max_points >= 60 THEN 'Good' ELSE 'Acceptable' END AS rating FROM s")
def expansion_scores(spark, sf_dir):
    """Whole texts as passages: of a plain query, of one that asks for a passage only, of one with a name that the expansion drops."""
    d = table(spark, sf_dir, "documents")
    plain = F.concat("source", F.lit(" deploy"))
    asked = F.when(F.col("lang") == "en", plain).when(F.col("lang") == "de", F.concat(plain, F.lit(" /only:hyde"))).otherwise("API deploy")
    said = F.concat(F.lit("lex: "), "lang", F.lit(" deploy\nvec: how to deploy with "), "lang", F.lit(" today\nhyde: "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    return reward.score(d.select("doc_id", asked.alias("query"), said.alias("expansion"))).select("doc_id", "total", "max_points", "rating")


@query(f"{EXPANDED} SELECT doc_id, CAST(CASE WHEN lang IN ('en', 'de') THEN 110 ELSE 120 END + passage AS INTEGER) AS total, 140 AS max_points FROM p")
def second_scores(spark, sf_dir):
    """The same expansions by the evaluation's own scorer, to which a query for one kind of line is a query like any other."""
    d = table(spark, sf_dir, "documents")
    plain = F.concat("source", F.lit(" deploy"))
    asked = F.when(F.col("lang") == "en", plain).when(F.col("lang") == "de", F.concat(plain, F.lit(" /only:hyde"))).otherwise("API deploy")
    said = F.concat(F.lit("lex: "), "lang", F.lit(" deploy\nvec: how to deploy with "), "lang", F.lit(" today\nhyde: "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    return reward.second_score(d.select("doc_id", asked.alias("query"), said.alias("expansion"))).select("doc_id", "total", "max_points")
