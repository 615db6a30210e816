"""Benchmark decontamination by a distributed positional inverted index: the training text's token postings are stored once, and the windows of the test items are looked up by intersecting offset-adjusted posting lists, rarest terms first.

A term is a word with the word after it (a window of one word is a term by itself), which keeps the lists of common words short. The index holds (term, document, position) of the terms that occur in test items, as a written table with no shuffle. Its counts order each window's terms; the postings of the rarest give candidate starts (position - offset), which must agree on the RARE rarest; only for the documents and windows that are left are the other terms' postings read, and a window matches where all its terms' adjusted lists meet. The index gives proximity matches too, whatever other documents hold: all of a window's terms but LOST (so that one altered word is forgiven), each within SLOP words of its place as one of the rarest tells it.

Edge cases: null and empty texts have no words; very long texts are read whole, a row at a time, and give as many postings as they hold terms of the items; an item of fewer than `length` words, but not none, is one window; rows that repeat are the same document, those that share a doc_id (null ones too) but not their text are documents of their own; rows that share an item_id are the same item; ties between equally rare terms go to the earlier offset; no items give no hits; no documents give no rows; further columns are ignored.
The vocabulary and windows of the items are broadcast only under a counted bound, and joined by shuffle beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import document_key, materialise, maybe_broadcast, table

#: What parts words. Splitting by it is several times as fast as extracting by the complement.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window (62 at most), terms that candidates must share, words that a proximity match's terms may be off, terms that it may lack: a replaced word breaks two.
LENGTH, RARE, SLOP, LOST = 10, 3, 4, 2


def words_of(text: Column) -> Column:
    """Words in their own case; an item's text is lower-cased in A-Z before."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """window id, size, words and item ids of every distinct window of the items."""
    own = items.select("item_id", words_of(lowered(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - length + 1))
    cut = own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, length))).alias("words"))
    # Equal windows of several items are looked up once; their items come back at the end.
    return cut.groupBy("words").agg(F.collect_set("item_id").alias("items")).select(F.xxhash64("words").alias("window"), "items", F.size("words").alias("size"), "words")


def window_terms(spans: DataFrame) -> DataFrame:
    """(window, size, n, off, word, next): the n terms of each window."""
    n = F.greatest(F.size("words") - 1, F.lit(1))
    offs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("off"), F.get("words", i).alias("word"), F.get("words", i + 1).alias("next")))
    return spans.select("window", "size", n.alias("n"), F.explode(offs).alias("t")).select("window", "size", "n", "t.*", F.xxhash64("t.word", "t.next").alias("term"))


def build_index(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (term, doc, pos) of the vocabulary (word, next, term), written without a shuffle; doc is the document's key."""
    split = documents.select(document_key().alias("doc"), words_of(F.col("text")).alias("w"))
    pairs = split.select("doc", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("pos", "t"))
    # Lower case by the fast function first; where that also folds letters beyond A-Z, the exact form decides.
    rows = pairs.select("doc", "pos", F.col("t.a").alias("a"), F.col("t.b").alias("b"))
    same = lambda own, word: (F.col(own) == F.col(word)) | (lowered(F.col(own)) == F.col(word))
    n = vocabulary.count()
    two = vocabulary.filter("next is not null").withColumn("la", F.lower("word")).withColumn("lb", F.lower("next"))
    index = rows.join(maybe_broadcast(two, n), (F.lower("a") == F.col("la")) & (F.lower("b") == F.col("lb"))).filter(same("a", "word") & same("b", "next")).select("term", "doc", "pos")
    one = vocabulary.filter("next is null").withColumn("la", F.lower("word"))
    if one.limit(1).count():
        index = index.unionByName(rows.join(maybe_broadcast(one, n), F.lower("a") == F.col("la")).filter(same("a", "word")).select("term", "doc", "pos"))
    return materialise(index, "postings")


def look_up(documents: DataFrame, items: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows (window, size, items), the index, and each window's terms that the documents hold, ranked by rarity (r); full: they hold all n."""
    spans = materialise(windows(items, length), "windows")
    placed = window_terms(spans)
    index = build_index(documents, materialise(placed.select("word", "next", "term").distinct(), "vocabulary"))
    frequency = materialise(index.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    # A window is ruled out only where the documents lack more of its terms than a proximity match may miss.
    ranked = placed.drop("word", "next").join(maybe_broadcast(frequency), "term").withColumn("all", F.count("*").over(Window.partitionBy("window"))).filter(F.col("all") >= needed())
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("window").orderBy("df", "off"))).select("window", "size", "n", "off", "term", "r", (F.col("all") == F.col("n")).alias("full"))
    return spans.select("window", "size", "items"), index, materialise(ranked, "terms")


def needed() -> Column:
    """Terms of n that a proximity match must have: all but LOST, and two where there are two."""
    return F.greatest(F.least("n", F.lit(2)), F.col("n") - LOST)


BIT = "shiftleft(1L, r - 1)"  # a term's place among its window's terms: repeated rows set it once


def find_exact(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc, window, size, start) of exact matches; start counts words from 0."""
    # A term that the documents lack rules its windows out.
    terms = ranked.filter("full")
    n_terms = terms.count()
    bit = F.expr(BIT).alias("bit")
    mine = ["doc", "window", "size", "n", (F.col("pos") - F.col("off")).alias("start"), bit]
    first = materialise(index.join(maybe_broadcast(terms.filter("r = 1"), n_terms), "term").select(*mine), "candidates")
    docs = maybe_broadcast(materialise(first.select("doc").distinct(), "candidate-docs"))
    rest = index.join(docs, "doc", "left_semi").join(maybe_broadcast(terms.filter(F.col("r").between(2, RARE)), n_terms), "term").select(*mine)
    place = ["doc", "window", "size", "n", "start"]
    lists = first.unionByName(materialise(rest, "rarer"))
    likely = materialise(lists.groupBy(*place).agg(F.bit_or("bit").alias("bits")).filter(f"bits = shiftleft(1L, least(n, {RARE})) - 1").select(*place), "likely")
    # The other terms, in the documents and windows that are left.
    more = terms.filter(F.col("r") > RARE).join(maybe_broadcast(likely.select("window").distinct()), "window", "left_semi").select("window", "off", "term", "r")
    wanted = likely.filter(F.col("n") > RARE).join(maybe_broadcast(more, n_terms), "window").select(*place, "term", (F.col("start") + F.col("off")).alias("pos"), bit)
    left = index.join(maybe_broadcast(likely.select("doc").distinct()), "doc", "left_semi").join(maybe_broadcast(more.select("term").distinct(), n_terms), "term", "left_semi")
    found = wanted.join(left, ["doc", "term", "pos"]).groupBy(*place).agg(F.bit_or("bit").alias("bits")).filter(f"bits = shiftleft(1L, n) - shiftleft(1L, {RARE})")
    out = ["doc", "window", "size", "start"]
    return found.select(*out).unionByName(likely.filter(F.col("n") <= RARE).select(*out))


def find_near(index: DataFrame, terms: DataFrame, exact: DataFrame) -> DataFrame:
    """(doc, window) of proximity matches, exact ones among them.

    A match lacks LOST terms at most, so it holds one of any LOST + 1 and two of any LOST + 2: the rarest that there are."""
    n_terms = terms.count()
    bit = F.expr(BIT).alias("bit")
    known = exact.select("doc", "window").distinct()
    lists = index.join(maybe_broadcast(terms.filter(F.col("r") <= LOST + 2), n_terms), "term").select("doc", "window", "n", (F.col("pos") - F.col("off")).alias("start"), bit)
    lists = lists.join(maybe_broadcast(known), ["doc", "window"], "left_anti")
    around = Window.partitionBy("doc", "window").orderBy("start").rangeBetween(-SLOP, SLOP)
    close = lists.withColumn("bits", F.bit_or("bit").over(around)).filter(f"bit < shiftleft(1L, {LOST + 1}) and bit_count(bits) >= least(n, 2)")
    places = materialise(close.select("doc", "window", "n", F.col("start").alias("at"), "bits").distinct(), "near-places")
    # The other terms, in the documents and windows that are left.
    more = terms.filter(F.col("r") > LOST + 2).join(maybe_broadcast(places.select("window").distinct()), "window", "left_semi").select("window", "off", "term", "r")
    cells = lambda c: F.floor(c / max(1, SLOP))
    mid = cells(F.col("at") + F.col("off"))
    wanted = places.join(maybe_broadcast(more, n_terms), "window").select("doc", "window", "n", "at", "term", "off", bit, F.explode(F.array(mid - 1, mid, mid + 1)).alias("cell"))
    left = index.join(maybe_broadcast(places.select("doc").distinct()), "doc", "left_semi").join(maybe_broadcast(more.select("term").distinct(), n_terms), "term", "left_semi")
    found = wanted.join(left.withColumn("cell", cells(F.col("pos"))), ["doc", "term", "cell"]).filter(F.abs(F.col("pos") - F.col("off") - F.col("at")) <= SLOP)
    both = places.unionByName(found.select("doc", "window", "n", "at", F.col("bit").alias("bits")))
    held = both.groupBy("doc", "window", "n", "at").agg(F.bit_or("bits").alias("bits")).filter(F.bit_count("bits") >= needed())
    return known.unionByName(held.select("doc", "window").distinct())


def covered(starts: Column) -> Column:
    """Words under an array of (start, size) structs, sorted: the length of the union."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["start"]))).alias("n"))

    return F.aggregate(starts, zero, step, lambda a: a["n"])


def scan(documents: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), n_near for every document."""
    spans, index, terms = look_up(documents, items, length)
    found = materialise(find_exact(index, terms), "exact")
    by_window = maybe_broadcast(spans.select("window", "items"))
    exact = found.join(by_window, "window")
    near = find_near(index, terms, found).join(by_window, "window")
    hits = exact.groupBy("doc").agg(
        F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string"))).alias("item_ids"),
    )
    loose = near.groupBy("doc").agg(F.size(F.array_distinct(F.flatten(F.collect_set("items")))).cast("long").alias("n_near"))
    hits = hits.select("doc", covered(F.col("spans")).cast("long").alias("n_hit"), "item_ids").join(loose, "doc", "full_outer")
    counted = documents.select("doc_id", document_key().alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(hits, F.col("key") == F.col("doc"), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + 9] AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, w[i : i + n - 1] AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM d, (SELECT DISTINCT n FROM bw))
), m AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
), terms AS (
  SELECT x, n, greatest(n - 1, 1) AS k, off, x[off + 1] AS a, x[off + 2] AS b FROM (SELECT x, n, unnest(range(greatest(n - 1, 1))) AS off FROM (SELECT DISTINCT x, n FROM bw))
), vocabulary AS (
  SELECT DISTINCT a, b FROM terms
), two AS (
  SELECT doc_id, pos, w[pos + 1] AS a, w[pos + 2] AS b FROM (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM d)
), postings AS (
  SELECT doc_id, pos, a, b FROM two JOIN vocabulary USING (a, b)
  UNION ALL SELECT doc_id, pos, a, NULL FROM two JOIN (SELECT a FROM vocabulary WHERE b IS NULL) USING (a)
), frequency AS (
  SELECT a, b, count(*) AS df FROM postings GROUP BY a, b
), ranked AS (
  SELECT x, k, off, t.a, t.b, row_number() OVER (PARTITION BY x ORDER BY df, off) AS r, count(*) OVER (PARTITION BY x) AS held
  FROM terms t JOIN frequency f ON t.a = f.a AND t.b IS NOT DISTINCT FROM f.b
), places AS (
  SELECT doc_id, x, k, r, pos - off AS place FROM ranked q JOIN postings p ON q.a = p.a AND q.b IS NOT DISTINCT FROM p.b WHERE held >= greatest(least(k, 2), k - 2)
), near AS (
  SELECT DISTINCT doc_id, x FROM (
    SELECT a.doc_id, a.x, a.place FROM (SELECT DISTINCT doc_id, x, k, place FROM places WHERE r <= 3) a JOIN places b ON a.doc_id = b.doc_id AND a.x = b.x AND abs(a.place - b.place) <= 4
    GROUP BY a.doc_id, a.x, a.k, a.place
    HAVING count(DISTINCT b.r) >= greatest(least(a.k, 2), a.k - 2) AND count(DISTINCT b.r) FILTER (WHERE b.r <= 4) >= least(a.k, 2))
), l AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT doc_id, item_id FROM near JOIN bw USING (x) UNION ALL SELECT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(t.l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def drop_contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents in which no window of an item occurs."""
    _, index, terms = look_up(documents, items)
    bad = materialise(find_exact(index, terms).select(F.col("doc").alias("bad")).distinct(), "contaminated")
    return documents.join(maybe_broadcast(bad), document_key() == F.col("bad"), "left_anti").select(documents.columns)
