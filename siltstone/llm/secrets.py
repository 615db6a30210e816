"""Secret scans: patterns, and sliding-window Shannon entropy by character class over candidate strings, with allow-list suppression, in Spark expressions only.

A candidate is a maximal run of a class's characters. A window of fixed length slides over it with the counts of its characters, of which each step changes two. A candidate whose best window reaches the class's limit is a span, unless an allow-list pattern explains it or the spans of patterns (and, for base64, of hex candidates) cover all of it. One that they cover in part stays whole; redact merges overlaps. All steps are linear in the text, or nearly (what is gathered in order is gathered in blocks).

Edge cases: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows each give a row; no rows give no rows; further columns are ignored."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import SCAN, let, scan, table

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the whole runs of 20 characters or more: what is shorter can't hold a longer one
HEX = r"[0-9a-f]{24,}"

#: Class: pattern of candidates, window, least entropy in bits, what a candidate must hold (letters and digits), what a text must hold to be looked at.
CLASSES = {
    "entropy_hex": (r"[0-9a-fA-F]{20,}", 20, 3.0),
    "entropy_base64": (r"[A-Za-z0-9+/_-]{24,}={0,2}", 24, 3.7),
}
#: All characters that a class has.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="
#: Candidates that these match are not secrets: words, snake or kebab identifiers, numbers, UUIDs, paths, placeholders.
ALLOW = [
    r"^[A-Za-z]+$",
    r"^[0-9+/_-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefgh",
]
#: ... and identifiers: words between separators. Split, not matched as a whole: a group that repeats too often overflows the matcher's stack.
BETWEEN, WORD, START = r"[_/+-]+", r"^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]{1,8})$", r"^[A-Z][a-z]"
KINDS = ["assign", "access", "hex", *CLASSES]
#: Bits that equal sums of logarithms may differ by.
CLOSE = 1e-9


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end, match>> of the leftmost non-overlapping matches, by the lengths of what lies between them."""

    def place(found: Column) -> Column:
        def walk(parts: Column) -> Column:
            lengths = F.transform(found, lambda m, i: F.struct(F.length(F.get(parts, i)).alias("gap"), F.length(m).alias("size")))
            zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
            step = lambda a, x: F.struct((a["end"] + x["gap"]).alias("start"), (a["end"] + x["gap"] + x["size"]).alias("end"))
            places = let(lengths, lambda v: scan(v, zero, step))
            return F.zip_with(places, found, lambda s, m: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), m.alias("match")))

        none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), walk)).otherwise(none)

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
    return F.filter(spans, keep) if keep else spans


def window_entropy(s: Column, window: int, alphabet: str = ALPHABET, enough: float = math.inf) -> Column:
    """The largest Shannon entropy, in bits, of any `window` consecutive characters of s (all of it, if shorter), or the first that is `enough`. Characters outside the alphabet count as one.

    The state holds how often each character is in the window, and the sum of c log2 c over these counts. A step changes two counts, that of the character that enters and of the one that leaves, and the sum by two entries of a table: its work does not depend on the length of s or of the window."""
    table_ = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    size = len(alphabet) + 1
    code = lambda c: F.instr(F.lit(alphabet), c)

    def scanned(f: Column, codes: Column, n: Column) -> Column:
        def add(counts: Column, k: Column, d: int) -> Column:
            return F.concat(F.slice(counts, 1, k), F.array(F.get(counts, k) + d), F.slice(counts, k + 2, size))

        def step(a: Column, x: Column) -> Column:
            i, new = x["i"], x["new"]
            old = F.get(codes, i - window)
            more = F.get(f, F.get(a["counts"], new) + 1) - F.get(f, F.get(a["counts"], new))

            def leave(counts: Column) -> Column:
                gone = F.get(f, F.get(counts, old)) - F.get(f, F.get(counts, old) - 1)
                total = a["sum"] + more - F.when(old.isNull(), 0.0).otherwise(gone)
                held = F.least(i + 1, F.lit(window))
                best = F.when((i + 1 >= window) | (i + 1 == n), F.log2(held.cast("double")) - total / held).otherwise(0.0)
                return F.struct(F.when(old.isNull(), counts).otherwise(add(counts, old, -1)).alias("counts"), total.alias("sum"), F.greatest(a["best"], best).alias("best"))

            return F.when(a["best"] >= enough, a).otherwise(let(add(a["counts"], new, 1), leave))

        zero = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.transform(codes, lambda c, i: F.struct(i.alias("i"), c.alias("new"))), zero, step, lambda a: a["best"])

    codes = F.transform(F.split(s, ""), code)
    return F.when(F.length(s) > 0, let(table_, lambda f: let(codes, lambda c: let(F.size(c), lambda n: scanned(f, c, n))))).otherwise(0.0)


def _uncovered(candidates: Column, base: Column) -> Column:
    """The candidates that base spans, sorted by start, do not cover between them: one pass over both, a candidate's turn coming at its end."""

    def apart(items: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            fresh = x["start"] > a["reach"]
            begin = F.when(fresh, x["start"]).otherwise(a["begin"])
            reach = F.when(fresh, x["end"]).otherwise(F.greatest(a["reach"], x["end"]))
            return F.struct(F.when(x["mine"], a["begin"]).otherwise(begin).alias("begin"), F.when(x["mine"], a["reach"]).otherwise(reach).alias("reach"))

        zero = F.struct(F.lit(-1).alias("begin"), F.lit(-1).alias("reach"))
        seen = F.zip_with(items, scan(items, zero, step), lambda x, a: F.struct(x["x"].alias("x"), (x["mine"] & ~((a["begin"] <= x["start"]) & (a["reach"] >= x["end"]))).alias("out")))
        return F.transform(F.filter(seen, lambda y: y["out"]), lambda y: y["x"])

    of = lambda spans, at, mine: F.transform(spans, lambda x: F.struct(x[at].alias("at"), F.lit(mine).alias("mine"), x["start"].alias("start"), x["end"].alias("end"), x.alias("x")))
    both = F.array_sort(F.concat(of(base, "start", False), of(candidates, "end", True)))
    return F.when((F.size(candidates) > 0) & (F.size(base) > 0), let(both, apart)).otherwise(candidates)


def _entropy_spans(text: Column, known: Column, kind: int) -> Column:
    """Spans of a class that neither the allow-list nor the known spans, sorted, explain."""
    pattern, window, least = CLASSES[KINDS[kind]]

    def secret(x: Column) -> Column:
        m = x["match"]
        ok = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        for a in ALLOW:
            ok = ok & ~m.rlike(a)
        words = F.split(m, BETWEEN, -1)
        ok = ok & ~((F.size(words) > 1) & ~m.rlike(START) & F.forall(words, lambda w: w.rlike(WORD)))
        return ok

    found = let(_spans(text, pattern, kind, secret), lambda c: _uncovered(c, known))
    return F.filter(found, lambda x: window_entropy(x["match"], window, ALPHABET, least - CLOSE) >= least - CLOSE)


def find_secrets(documents: DataFrame) -> DataFrame:
    """documents' doc_id and text with base, spans: array<struct<start, kind, end, match>>, sorted by start, then kind; kind indexes KINDS."""
    return _found(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "text", "base", "spans")


def _found(rows: DataFrame) -> DataFrame:
    """rows with base and spans, computed from text."""
    assign = _spans(F.col("text"), ASSIGN, 0, lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= 6)
    rows = rows.select("*", F.array_sort(F.concat(assign, _spans(F.col("text"), ACCESS, 1), _spans(F.col("text"), HEX, 2))).alias("base"))
    rows = rows.select("*", F.col("base").alias("spans"))
    for k in range(3, len(KINDS)):  # each class leaves out what patterns and the classes before it cover
        more = _entropy_spans(F.col("text"), F.col("spans"), k)
        rows = rows.withColumn("spans", F.array_sort(F.concat("spans", more)))
    return rows


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """text with every span, overlapping ones as one, replaced by mark; spans as find_secrets sorts them."""

    def joined(reach: Column, cut) -> Column:
        def piece(x: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reach, i - 1), F.lit(0))
            return F.when(x["start"] >= at, F.concat(cut(at, x["start"] - at), F.lit(mark))).otherwise("")

        last = F.element_at(reach, -1)
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(last, F.length(text) - last))

    reach = scan(spans, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
    # A substring is looked for from the text's start; where there are many, the text is parted into its characters once.
    few = lambda at, n: F.substr(text, at + 1, n)
    many = let(F.split(text, ""), lambda c: let(reach, lambda r: joined(r, lambda at, n: F.array_join(F.slice(c, at + 1, n), ""))))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) <= SCAN, let(reach, lambda r: joined(r, few))).otherwise(many)


def mask(documents: DataFrame) -> DataFrame:
    """documents with every span masked in text, and n_chars, where there is one, counted anew."""
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = _found(rows).select("row", F.when(F.col("row.text").isNotNull(), redact(F.col("text"), F.col("spans"))).alias("text"))
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[fresh.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: The allow-list's words are one pattern here, since this matcher needs no stack.
OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
), k AS (
  SELECT * FROM (VALUES (0, 'assign', '{ASSIGN.replace("'", "''")}'), (1, 'access', '{ACCESS}'), (2, 'hex', '{HEX}'), (3, 'entropy_hex', '{CLASSES["entropy_hex"][0]}'), (4, 'entropy_base64', '{CLASSES["entropy_base64"][0]}')) AS v(kind, name, p)
), f AS (
  SELECT r, kind, regexp_extract_all(t, '{ASSIGN.replace("'", "''")}') AS m, regexp_split_to_array(t, '{ASSIGN.replace("'", "''")}') AS g FROM d, k WHERE kind = 0
  UNION ALL SELECT r, kind, regexp_extract_all(t, '{ACCESS}'), regexp_split_to_array(t, '{ACCESS}') FROM d, k WHERE kind = 1
  UNION ALL SELECT r, kind, regexp_extract_all(t, '{HEX}'), regexp_split_to_array(t, '{HEX}') FROM d, k WHERE kind = 2
  UNION ALL SELECT r, kind, regexp_extract_all(t, '{CLASSES["entropy_hex"][0]}'), regexp_split_to_array(t, '{CLASSES["entropy_hex"][0]}') FROM d, k WHERE kind = 3
  UNION ALL SELECT r, kind, regexp_extract_all(t, '{CLASSES["entropy_base64"][0]}'), regexp_split_to_array(t, '{CLASSES["entropy_base64"][0]}') FROM d, k WHERE kind = 4
), one AS (
  SELECT r, kind, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g[1 : len(m)]) AS g FROM f WHERE len(m) > 0
), placed AS (
  SELECT r, kind, m, sum(length(g) + length(m)) OVER w - length(m) AS a, sum(length(g) + length(m)) OVER w AS z FROM one WINDOW w AS (PARTITION BY r, kind ORDER BY i)
), base AS (
  SELECT * FROM placed WHERE kind = 0 AND length(regexp_extract(m, '{ASSIGN.replace("'", "''")}', 1)) >= 6 OR kind IN (1, 2)
), c AS (
  SELECT * FROM placed WHERE kind > 2 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
    AND NOT regexp_matches(m, '{ALLOW[0]}') AND NOT regexp_matches(m, '{ALLOW[1]}') AND NOT regexp_matches(m, '{ALLOW[2]}') AND NOT regexp_matches(m, '{ALLOW[3]}')
    AND NOT regexp_matches(m, '^(?:[a-z]+|[A-Z]+|[0-9]{{1,8}})(?:[_/+-]+(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]{{1,8}}))+$')
), high AS (
  SELECT r, kind, m, a, z FROM (SELECT *, CASE kind WHEN 3 THEN {CLASSES["entropy_hex"][1]} ELSE {CLASSES["entropy_base64"][1]} END AS w FROM c)
  WHERE list_max(list_transform(range(0, greatest(length(m) - w, 0) + 1), lambda i: list_aggregate(string_split(substr(m, i + 1, w), ''), 'entropy'))) >= CASE kind WHEN 3 THEN {CLASSES["entropy_hex"][2]} ELSE {CLASSES["entropy_base64"][2]} END - {CLOSE}
), points AS (
  SELECT r, kind, a, z, unnest(range(a, z)) AS q FROM (SELECT r, kind, CAST(a AS BIGINT) AS a, CAST(z AS BIGINT) AS z FROM high)
), hexes AS (
  SELECT DISTINCT r, kind, a, z FROM points p WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = p.r AND b.a <= p.q AND p.q < b.z)
), known AS (
  SELECT r, kind, a, z FROM base UNION ALL SELECT r, kind, a, z FROM hexes
), spans AS (
  SELECT * FROM known UNION ALL SELECT DISTINCT r, kind, a, z FROM points p WHERE kind = 4 AND NOT EXISTS (SELECT 1 FROM known b WHERE b.r = p.r AND b.a <= p.q AND p.q < b.z)
), named AS (
  SELECT r, kind, a, z, name || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT) AS x FROM spans JOIN k USING (kind)
), s AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(x, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS b, string_agg(x, ',' ORDER BY a, kind) AS l FROM named GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(l, '') AS spans
FROM d LEFT JOIN s USING (r)
"""
