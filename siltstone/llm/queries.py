"""The queries of this package's operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from siltstone.llm import chat, counts, decontaminate, jaccard, negatives, pieces, quality, secrets, shard, substrings, topk, toxicity, turns

QUERIES = {
    "op1_suffix_array_dedup": substrings.op1_suffix_array_dedup,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_sharding": shard.op4_sharding,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_token_counts": counts.op6_token_counts,
    "op7_ngram_jaccard_join": jaccard.op7_ngram_jaccard_join,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_exact_top_k": topk.op11_exact_top_k,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_structure_repair": turns.op13_structure_repair,
}

OP7_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS x FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * o >= 85 * (a.n + b.n - o)
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT l.v, reach.root FROM reach JOIN l ON l.u = reach.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY 1, 2
"""

ORACLES = {
    "op2_secret_scans": secrets.OP2_SQL,
    "op3_decontamination": decontaminate.OP3_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
    "op11_exact_top_k": topk.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
