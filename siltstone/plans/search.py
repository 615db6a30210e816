"""Query pipelines: plain, structured, vector and hybrid search over one index."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.analyzer import QueryError, TypedQuery, intent_terms, parse_document, parse_query, python_tokens, validate
from siltstone.operators import bm25, chunk, fusion, vector

LEXICAL, FETCH = 20, 20


class Index:
    """What a search reads: documents (id, collection, path, title, hash, active, source_type), postings (none: the documents' filepath, title and body are scanned), lengths, and chunks with vectors. Texts are the documents' body or, apart from them, content (hash, doc)."""

    def __init__(self, documents: DataFrame, postings: DataFrame | None = None, lengths: DataFrame | None = None, chunks: DataFrame | None = None, analyse: Callable[[str], str] | None = None, content: DataFrame | None = None, stats: tuple[int, float] | None = None, split: Callable[[str], list[str]] = python_tokens):
        """analyse is what was done to the postings' terms, and split what made them, and both are done to a query's; stats, the number of documents and their mean length, go with postings that hold lengths, in place of lengths."""
        self.documents, self.postings, self.lengths, self.chunks, self.analyse = documents, postings, lengths, chunks, analyse or (lambda t: t)
        self.content, self.stats, self.split = content, stats, split

    def bodies(self, files: DataFrame) -> DataFrame:
        """(file, body) of a search's few candidates; of a content store, only the row groups of their hashes are read."""
        wanted = self.documents.join(F.broadcast(files.select("file")), F.col("id") == F.col("file"))
        if self.content is None:
            return wanted.select("file", "body")
        named = wanted.select("file", "hash")
        rows = named.collect()  # fusion's candidates at most
        held = self.documents.sparkSession.createDataFrame(rows, named.schema)
        among = reduce(or_, (F.col("hash") == h for h in sorted({r["hash"] for r in rows})), F.lit(False))
        return self.content.filter(among).join(F.broadcast(held), "hash").select("file", F.col("doc").alias("body"))

    def lexical(self, query: str, limit: int = LEXICAL, collection: str | None = None, source_type: str | None = None, exact: bool = False) -> DataFrame:
        return bm25.search(self.postings, self.lengths, self.documents, parse_query(query, self.analyse, self.split), limit, collection, source_type, exact, self.stats)

    def nearest(self, query: list[float], limit: int = LEXICAL, collection: str | None = None) -> DataFrame:
        if self.chunks is None:
            raise ValueError("no vectors")
        return vector.search(self.chunks, self.documents, query, limit, collection)


def _listed(rows: DataFrame, number: int) -> DataFrame:
    return rows.select(F.lit(number).alias("list"), F.col("id").alias("file"), "score")


def _fused(index: Index, lists: list[DataFrame], heavy: int, query: str, intent: str | None, reranker, limit: int, least: float, memo=None) -> DataFrame:
    """Lists to results: fuse, keep the candidates, choose their best chunks, score those, blend."""
    both = lists[0]
    for x in lists[1:]:
        both = both.unionByName(x)
    ranked = fusion.rank_lists(both)
    chosen = fusion.candidates(fusion.fuse(ranked, fusion.first_heavy(len(lists), heavy)))
    if reranker is None:
        return fusion.finish(chosen.withColumn("score", 1 / F.col("place")), limit, least)
    cut = chunk.chunk_documents(index.bodies(chosen), "file", "body")
    best = fusion.best_chunk(cut, query, intent_terms(intent) if intent else None)
    scored = fusion.rerank(best, query, reranker, memo)
    return fusion.finish(fusion.blend(chosen.join(scored, "file")), limit, least)


def hybrid(index: Index, query: str, expander: Callable[[str], list[TypedQuery]] | None = None, embedder: Callable[[list[str]], list[list[float]]] | None = None, reranker: Callable[[str, list[str]], list[float]] | None = None, intent: str | None = None, collection: str | None = None, limit: int = 10, least: float = 0.0, memo=None) -> DataFrame:
    """A plain query: its own lexical hits, unless they are strong also its expansions', and vector hits of it and its variants. A memo (memo.Memo) keeps what the expander and the reranker say."""
    found = index.lexical(query, LEXICAL, collection).select("id", "score")
    hits = found.collect()  # LEXICAL rows at most, read once for the scores and the fusion
    own = index.documents.sparkSession.createDataFrame(hits, found.schema)
    top = [r["score"] for r in hits[:2]]
    expander = memo.expander(expander) if memo is not None and expander is not None else expander
    typed = [] if expander is None or fusion.strong_signal(top, intent) else expander(query)
    lists = [own] if top else []
    lists += [index.lexical(q.text, LEXICAL, collection) for q in typed if q.type == "lex"]
    if embedder is not None and index.chunks is not None:
        texts = [query, *(q.text for q in typed if q.type in ("vec", "hyde"))]
        lists += [index.nearest(v, LEXICAL, collection) for v in embedder(texts)]
    if not lists:
        lists = [own]
    return _fused(index, [_listed(x, i) for i, x in enumerate(lists)], 2, query, intent, reranker, limit, least, memo)


def structured(index: Index, searches: list[TypedQuery], collections: list[str | None] | None = None, embedder=None, reranker=None, intent: str | None = None, limit: int = 10, least: float = 0.0, memo=None) -> DataFrame:
    """Typed queries, one list each for every collection asked for; lexical lists come first, and the first list counts double."""
    for q in searches:
        if (wrong := validate(q)) is not None:
            raise QueryError(f"line {q.line}: {wrong}")
    if not searches:
        raise QueryError("no query")
    names = collections or [None]
    lists = [index.lexical(q.text, LEXICAL, c) for q in searches if q.type == "lex" for c in names]
    vectors = [q for q in searches if q.type in ("vec", "hyde")]
    if vectors and embedder is not None and index.chunks is not None:
        lists += [index.nearest(v, LEXICAL, c) for v in embedder([q.text for q in vectors]) for c in names]
    by_type = {t: next((q.text for q in searches if q.type == t), None) for t in ("lex", "vec")}
    primary = by_type["lex"] or by_type["vec"] or searches[0].text
    return _fused(index, [_listed(x, i) for i, x in enumerate(lists)], 1, primary, intent, reranker, limit, least, memo)


def search(index: Index, text: str, **options) -> DataFrame:
    """Either of the two, by the text's form."""
    parsed = parse_document(text)
    if parsed is None:
        plain = text.strip()
        plain = plain.split(":", 1)[1].strip() if plain.lower().startswith("expand:") else plain
        return hybrid(index, plain, **options)
    typed, intent = parsed
    options.pop("expander", None)
    one = options.pop("collection", None)
    return structured(index, typed, [one] if one else None, intent=options.pop("intent", None) or intent, **options)


def expand(query: str, model: Callable[[str], str]) -> list[TypedQuery]:
    """A model's typed lines, without those that share no term with the query; plain variants if nothing is left."""
    words = set(query.lower().split())
    out = []
    for line in model(query).split("\n"):
        kind, _, text = line.strip().partition(":")
        if kind in ("lex", "vec", "hyde") and text.strip() and (kind == "hyde" or words & set(text.lower().split())):
            out.append(TypedQuery(kind, text.strip()))
    return out or [TypedQuery("lex", query), TypedQuery("vec", query), TypedQuery("hyde", f"Information about {query}")]


#: Rows fetched for a command that wants n, and for one that wants all. Fixed values.
FETCH_LEAST, FETCH_ALL = 50, 100_000


def fetch_limit(n: int, everything: bool = False) -> int:
    return FETCH_ALL if everything else max(FETCH_LEAST, 2 * n)


def command(index: Index, query: str, n: int = 5, everything: bool = False, least: float = 0.0, collections: list[str] | None = None) -> DataFrame:
    """What the search command shows: of a fetch that is larger than n (all: of all), the files of some collections with a least score, the first n of them or all."""
    found = index.lexical(query, fetch_limit(n, everything), collections[0] if collections and len(collections) == 1 else None)
    kept = found.filter(F.col("score") >= least)
    if collections:
        kept = kept.filter(F.col("collection").isin(collections))
    ordered = kept.orderBy(F.desc("bm25"), "id")
    return ordered if everything else ordered.limit(n)
