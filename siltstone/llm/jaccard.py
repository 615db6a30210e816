"""N-gram Jaccard join by vertical partitioning: the global order of n-grams is cut into fragments, the overlap of a pair is counted in each fragment by itself, and the counts are summed per pair.

A document is the set of its distinct n-grams of words, as 64-bit hashes; equal sets are one class from the start, and a class is known by a hash of its own (checked for collisions with a second one). Between documents n-grams are compared by 40 bits of their hash within a part that more bits choose (4 at least): some two n-grams in a part of 2,000,000 are taken for equal that aren't, which can add one to a pair's overlap, so a pair one n-gram short of the threshold could be linked, once in many billions of pairs; an overlap is never counted too low.

1. Order. N-grams are dealt to parts by their hash and counted there; those that several classes hold go back to their classes, which sort them into the global order: by document frequency, rarest first, ties by hash. N-grams that a large share of all documents holds would make one part long, so they are found while the sets are made, come last in the order as they are, and are not dealt. Classes whose unshared n-grams rule out any link are done; the others are written as profiles: their shared n-grams in the global order, cut into FRAGMENTS at powers of two of the document frequency.
2. Candidates. Two sets that reach the threshold share an n-gram in the first fragment of each, its prefix of n - ceil(t n) + 1 n-grams. N-grams with the same members are one bucket, found by aggregates, so that no task holds a bucket. The prefix is counted first, and pairs that can't reach the threshold with all that comes after it are dropped.
3. Overlaps. For what is left the profiles' fragments meet by (pair, fragment), each pair's common n-grams are counted per fragment, and the sum decides.

Links are looked for where they can still join components. In each bucket some members lead and are compared with all others whose size and place of the shared n-gram (as the first that the pair shares) allow a link and which are in another component: first the member that shares most bucket places, and of all leads only a class's best; then about 4, 16, 64, ... leads a bucket, by the order of a hash, until every bucket is one component or all its members have led. A group of copies thus costs about one comparison a member, no partner is left out, and no link between different components is lost. Texts put together from a stock of common passages, which share whole passages and still do not link, are the costly case: the members of such a bucket are compared with each other until all have led, so pairs grow with the square of a bucket.

Edge cases: null and empty texts have an empty set and are their own component; fewer words than n make one n-gram of their own kind; repeated rows and equal sets are linked; rows that share a doc_id but not their text are documents of their own; a null doc_id sorts before all others; no rows give no rows; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, maybe_broadcast, released, small_batches, table
from siltstone.llm.components import components
from siltstone.llm.substrings import M1, NULL_ID, Ranges, _mix

#: Bytes shingled at a time; n-grams dealt at a time; n-grams of a part, about, and the fewest parts.
CHUNK, DEALT, PART, LEAST_PARTS = 1 << 20, 500_000, 2_000_000, 16
#: Tasks that parts are dealt to at most; a task reads its parts one after the other.
MOST_TASKS = 20_000
#: An n-gram is hot if documents of chunks where OFTEN or more hold it come to HOT or more, and to a HOT_SHARE of all n-grams: there are 1 / HOT_SHARE at most.
OFTEN, HOT, HOT_SHARE = 4, 50_000, 1e-6
#: Document frequencies at which the global order of n-grams is cut, and how many fragments that makes.
CUTS = [3, 5, 9, 17, 33, 65, 129]
FRAGMENTS = len(CUTS) + 1
#: N-grams of leading profiles that are broadcast at most.
BROADCAST_TOKENS = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every text's distinct n-grams, sorted; words are lower-cased in A-Z and parted by ASCII white space."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    gap = _SPACE[data]
    before = np.r_[True, gap[:-1]]
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(gap & ~before)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = Ranges(data, 1).of(start, end, 0)
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, start, side="right")
    count = np.bincount(of, minlength=len(texts))

    def fold(at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = _mix(h * np.uint64(M1) + word[at + k])
        return h

    full = np.arange(max(0, len(word) - size + 1))
    full = full[of[full] == of[full + size - 1]]
    docs, hashes = [of[full]], [fold(full, size)]
    first = np.searchsorted(of, np.arange(len(texts)))
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        docs.append(short)
        hashes.append(fold(first[short], n))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    by = np.argsort(h)
    by = by[np.argsort(doc[by].astype(np.uint16), kind="stable")]  # a radix sort: a chunk has fewer than 2^15 texts
    doc, h = doc[by], h[by]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], h[new]


def _chunks(batches: Iterator, columns: int = 2) -> Iterator[tuple[list, list[bytes], list]]:
    """ids, texts and what a third column holds, about CHUNK bytes at a time."""
    for b in batches:
        ids, texts, extra, size = [], [], [], 0
        more = b.column(2).to_pylist() if columns > 2 else [None] * b.num_rows
        for i, t, e in zip(b.column(0).to_pylist(), b.column(1), more, strict=True):
            raw = t.as_buffer()
            ids.append(i)
            texts.append(b"" if raw is None else raw.to_pybytes())
            extra.append(e)
            size += len(texts[-1])
            if size >= CHUNK or len(ids) >= 30_000:
                yield ids, texts, extra
                ids, texts, extra, size = [], [], [], 0
        if ids:
            yield ids, texts, extra


def _keys(doc: np.ndarray, h: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of n texts' sets and two 64-bit hashes of each set."""
    bounds = np.searchsorted(doc, np.arange(n + 1))
    out = [np.diff(bounds)]
    for m in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9):
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(_mix(h ^ np.uint64(m + 2 * seed)))]
        out.append(_mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return tuple(out)


def _batch(schema, **columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _five(token: np.ndarray) -> np.ndarray:
    """The low five bytes of each number, a row each."""
    return np.ascontiguousarray(token.view(np.uint8).reshape(-1, 8)[:, :5])


def _packs(part: np.ndarray, doc: np.ndarray, **columns: np.ndarray) -> dict[str, list]:
    """One row a part of rows sorted by part and document: the columns' bytes, and the documents with how many rows each has, 255 at most at a time."""
    if not len(doc):
        return {k: [] for k in ("part", *columns, "docs", "counts")}
    new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])])
    many = np.diff(np.r_[new, len(doc)])
    if many.max() > 255:
        place = np.arange(len(doc)) - np.repeat(new, many)
        new = np.flatnonzero(place % 255 == 0)
        many = np.diff(np.r_[new, len(doc)])
    at = np.r_[new, len(doc)]
    own, many, where = doc[new], many.astype(np.uint8), part[new]
    cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    both = list(zip(cut.tolist(), np.r_[cut[1:], len(where)].tolist(), strict=True))
    out = {k: [v[at[a] : at[z]].tobytes() for a, z in both] for k, v in columns.items()}
    return {"part": where[cut], **out, **{k: [v[a:z].tobytes() for a, z in both] for k, v in (("docs", own), ("counts", many))}}


def _by_part(batches: Iterator) -> Iterator[tuple[int, dict[str, bytes]]]:
    """Each part of rows sorted by part, with its columns' bytes end to end."""
    now, held = None, {}
    for b in batches:
        names = [x for x in b.schema.names if x != "part"]
        columns = {k: b.column(b.schema.get_field_index(k)).to_pylist() for k in names}
        for i, part in enumerate(b.column(b.schema.get_field_index("part")).to_pylist()):
            if part != now:
                if now is not None:
                    yield now, {k: b"".join(v) for k, v in held.items()}
                now, held = part, {k: [] for k in names}
            for k in names:
                held[k].append(columns[k][i])
    if now is not None:
        yield now, {k: b"".join(v) for k, v in held.items()}


def _place(doc: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _sets(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """doc, th, n, s1, s2 of every row (doc, text, th), where s1 alone tells sets apart; n-grams s1 that several documents of a chunk hold, n times; the hashes' seed."""
    import pyarrow as pa

    summary = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("gram", pa.bool_())])
    for seed in range(8):

        def survey(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for ids, texts, th in _chunks(batches, 3):
                doc, h = shingles(texts, size)
                n, s1, s2 = _keys(doc, h, len(ids), seed)
                yield _batch(summary, doc=ids, th=th, n=n, s1=s1, s2=s2, gram=np.zeros(len(ids), bool))
                once = np.zeros(len(ids), bool)
                once[np.unique(s1, return_index=True)[1]] = True
                s = np.sort(h[once[doc]])
                new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
                times = np.diff(np.r_[new, len(s)])
                new, times = new[times >= OFTEN], times[times >= OFTEN]
                zero = np.zeros(len(new), np.int64)
                yield _batch(summary, doc=zero, th=zero, n=times, s1=s[new].view(np.int64), s2=zero, gram=np.ones(len(new), bool))

        found = materialise(rows.mapInArrow(released(survey), "doc long, th long, n long, s1 long, s2 long, gram boolean"), "jaccard-sets")
        sets = found.filter("not gram").drop("gram")
        if not sets.groupBy("s1").agg(((F.min("s2") < F.max("s2")) | (F.min("n") < F.max("n"))).alias("two")).filter("two").limit(1).count():
            return sets, found.filter("gram").select("s1", "n"), seed
    raise RuntimeError("hashes of different sets are equal for every seed")


def _profiles(single: DataFrame, hot: np.ndarray, parts: int, seed: int, size: int, num: int, den: int) -> DataFrame:
    """doc, n, own, tokens, ends: of each class that may have a link, how many n-grams no other class holds, the others in the global order, and where its fragments end."""
    import pyarrow as pa

    # A row has n-grams, of classes docs, counts of each, or (names, sizes) of classes.
    columns = "part int, tokens binary, dfs binary, docs binary, counts binary, names binary, sizes binary"
    packed = pa.schema([("part", pa.int32()), *((c.split()[0], pa.binary()) for c in columns.split(", ")[1:])])
    last = np.iinfo(np.int32).max

    def rows(x: dict[str, list]) -> pa.RecordBatch:
        return _batch(packed, **{c: x.get(c, [b""] * len(x["part"])) for c in packed.names})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """N-grams by part, five bytes each: the high bits of the hash, whose low bits are the part. Hot ones, and the sizes, go straight to their class's part, which comes after the others."""

        def pack(held: list) -> Iterator[pa.RecordBatch]:
            doc, h = (np.concatenate(x) for x in zip(*held, strict=True))
            straight = np.zeros(len(h), bool)
            if len(hot):
                straight = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
            part = (h % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part.astype(np.uint16), kind="stable") if parts <= 1 << 16 else np.argsort(part, kind="stable")
            by = by[~straight[by]]
            yield rows(_packs(part[by], doc[by], tokens=_five(h[by] >> np.uint64(24))))
            if straight.any():
                doc, h = doc[straight], h[straight]
                to = parts + _place(doc, parts)
                by = np.argsort(to, kind="stable")
                yield rows(_packs(to[by], doc[by], tokens=h[by] >> np.uint64(24) << np.uint64(24) | h[by] % np.uint64(parts), dfs=np.full(len(by), last, np.int32)))

        def name(held: list) -> pa.RecordBatch:
            doc, n = (np.concatenate(x) for x in zip(*held, strict=True))
            to = parts + _place(doc, parts)
            by = np.argsort(to, kind="stable")
            x = _packs(to[by], doc[by], sizes=n[by].astype(np.int32))
            return rows({"part": x["part"], "names": x["docs"], "sizes": x["sizes"]})

        held, named, many = [], [], 0
        for ids, texts, _ in _chunks(batches):
            doc, h = shingles(texts, size)
            if len(doc):
                n, s1, _ = _keys(doc, h, len(ids), seed)
                held.append((s1[doc], h))
                named.append((s1[n > 0], n[n > 0]))
                many += len(doc)
            if many >= DEALT:
                yield from pack(held)
                yield name(named)
                held, named, many = [], [], 0
        if held:
            yield from pack(held)
            yield name(named)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-grams of a part that several classes hold, with how many, on their way back to the classes."""
        for part, x in _by_part(batches):
            if part >= parts:
                yield rows({"part": [part - parts], **{k: [v] for k, v in x.items()}})
                continue
            five = np.frombuffer(x["tokens"], np.uint8).reshape(-1, 5)
            wide = np.zeros((len(five), 8), np.uint8)
            wide[:, :5] = five
            token, doc = wide.view(np.uint64).ravel(), np.repeat(np.frombuffer(x["docs"], np.int64), np.frombuffer(x["counts"], np.uint8))
            by = np.argsort(token)
            token, doc = token[by], doc[by]
            new = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            times = np.diff(np.r_[new, len(token)])
            df = np.repeat(times, times)
            shared = df > 1
            token, doc, df = (token[shared] << np.uint64(24)) | np.uint64(part), doc[shared], df[shared].astype(np.int32)
            to = _place(doc, parts)
            by = np.lexsort((doc, to))
            yield rows(_packs(to[by], doc[by], tokens=token[by], dfs=df[by]))

    profile = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("tokens", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32()))])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _by_part(batches):
            doc = np.repeat(np.frombuffer(x["docs"], np.int64), np.frombuffer(x["counts"], np.uint8))
            name, n = np.frombuffer(x["names"], np.int64), np.frombuffer(x["sizes"], np.int32)
            by = np.argsort(name)
            name, n = name[by], n[by].astype(np.int64)
            token, df = np.frombuffer(x["tokens"], np.int64), np.frombuffer(x["dfs"], np.int32)
            by = np.lexsort((token, df, doc))
            token, df, doc = token[by], df[by], doc[by]
            new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
            many = np.diff(np.r_[new, len(doc)])
            doc = doc[new]
            n = n[np.searchsorted(name, doc)]
            own = n - many
            use = own < n - (num * n + den - 1) // den + 1
            fragment = np.repeat(np.arange(len(new)), many) * FRAGMENTS + np.searchsorted(CUTS, df, side="right")
            ends = np.bincount(fragment, minlength=len(new) * FRAGMENTS).reshape(-1, FRAGMENTS).cumsum(axis=1)[use].astype(np.int32)
            token = token[np.repeat(use, many)]
            doc, n, own, many = doc[use], n[use], own[use], many[use]
            at = np.r_[0, np.cumsum(many)]
            a = 0
            while a < len(doc):
                z = max(a + 1, int(np.searchsorted(at, at[a] + DEALT, side="right")) - 1)
                lists = pa.ListArray.from_arrays(pa.array((at[a : z + 1] - at[a]).astype(np.int32)), pa.array(token[at[a] : at[z]]))
                cuts = pa.ListArray.from_arrays(pa.array(np.arange(0, (z - a + 1) * FRAGMENTS, FRAGMENTS, dtype=np.int32)), pa.array(ends[a:z].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(doc[a:z]), pa.array(n[a:z]), pa.array(own[a:z]), lists, cuts], schema=profile)
                a = z

    tasks = min(2 * parts, MOST_TASKS)
    dealt = single.select("doc", "text").mapInArrow(released(deal), columns).repartition(tasks, "part").sortWithinPartitions("part")
    listed = dealt.mapInArrow(released(count), columns).repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part")
    return materialise(listed.mapInArrow(released(sort), "doc long, n long, own long, tokens array<long>, ends array<int>"), "jaccard-profiles")


def _buckets(profiles: DataFrame, num: int, den: int) -> DataFrame:
    """bucket, doc, n, w, i, width, weight, pos: a class in each bucket of its prefix; w n-grams make up the bucket for it, i is the place of the first in its order; width classes are in the bucket, and weight is the sum of the widths of the class's buckets; pos in [0, 1) by hash."""
    prefix = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1 - own").cast("int")
    entries = profiles.select("doc", "n", "own", F.posexplode(F.slice("tokens", 1, prefix)).alias("k", "token"))
    # An n-gram's members are known by their number and an aggregate of their hashes.
    lists = entries.groupBy("token").agg(F.count("*").alias("width"), F.bit_xor(F.xxhash64("doc")).alias("x")).filter("width > 1")
    lists = materialise(lists.select("token", "width", F.xxhash64("x", "width").alias("bucket")), "jaccard-lists")
    members = entries.join(maybe_broadcast(lists), "token").groupBy("bucket", "doc", "n").agg(F.count("*").alias("w"), F.min(F.col("own") + F.col("k")).alias("i"), F.first("width").alias("width"))
    members = materialise(members, "jaccard-members")
    weight = members.groupBy("doc").agg(F.sum("width").alias("weight"))
    pos = F.xxhash64("doc", F.lit(7)).bitwiseAND((1 << 52) - 1) / F.lit(float(1 << 52))
    return materialise(members.join(weight, "doc").withColumn("pos", pos), "jaccard-buckets")


def _likely(pairs: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that share enough n-grams of their prefixes. Of the set whose prefix ends first, what the pair shares up to there is in both prefixes, and ceil(t n) - 1 n-grams come after it; so the overlap is at most the shared ones and these."""
    both = pairs.join(prefixes.select(F.col("doc").alias("p"), F.col("m").alias("mp")), "p").join(prefixes, "doc")
    common = both.withColumn("c", F.aggregate(F.array_intersect(F.map_keys("m"), F.map_keys("mp")), F.lit(0).cast("long"), lambda a, b: a + F.element_at("m", b)))
    rest = f"greatest(({num} * n + {den - 1}) div {den}, ({num} * np + {den - 1}) div {den}) - 1"
    return common.filter(f"{num + den} * (c + {rest}) >= {num} * (n + np)").select("doc", "n", "p", "np")


def _verify(profiles: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame | None:
    """The pairs (doc, n, p, np) that reach the threshold; None if there are no pairs. Each fragment of the global order is counted by itself."""
    n_pairs = pairs.count()
    if not n_pairs:
        return None

    def cut(rows: DataFrame, of: str, name: str) -> DataFrame:
        """A row for each fragment that is not empty."""
        low = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0))
        fragments = F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda k: F.struct(k.alias("fragment"), F.slice("tokens", low(k) + 1, F.get("ends", k) - low(k)).alias(name)))
        return rows.select(*of.split(), F.explode(F.filter(fragments, lambda x: F.size(x[name]) > 0)).alias("x")).select(*of.split(), "x.*")

    leads = materialise(profiles.join(maybe_broadcast(pairs.select(F.col("p").alias("doc")).distinct(), n_pairs), "doc", "left_semi").withColumnRenamed("doc", "p"), "jaccard-leads")
    tokens = leads.agg(F.sum(F.size("tokens"))).first()[0] or 0
    lead = cut(leads, "p", "tokens_p")
    lead = F.broadcast(lead) if tokens <= BROADCAST_TOKENS else lead.hint("shuffle_merge")
    mine = cut(profiles.join(maybe_broadcast(pairs.select("doc", "p"), n_pairs), "doc"), "doc p", "tokens_d")
    partial = mine.join(lead, ["p", "fragment"]).select("doc", "p", F.size(F.array_intersect("tokens_d", "tokens_p")).alias("o"))
    overlap = partial.groupBy("doc", "p").agg(F.sum("o").alias("o"))
    return materialise(pairs.join(overlap, ["doc", "p"]).filter(f"{num + den} * o >= {num} * (n + np)").select("doc", "p"), "jaccard-links")


def _components(profiles: DataFrame, num: int, den: int) -> DataFrame:
    """(doc, comp) of the classes that are linked to another and are not their component's name, which is a class too."""
    members = _buckets(profiles, num, den)
    prefixes = materialise(members.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m")), "jaccard-prefixes")  # as many as its prefix has n-grams
    place: list[Column] = [F.struct("pos", "doc"), F.struct(F.col("pp").alias("pos"), F.col("p").alias("doc"))]
    bound = f"{den} * least(n, np) >= {num} * greatest(n, np) and {num + den} * least(n - i, np - ip) >= {num} * (n + np)"
    labels, partners, least = None, 1, 0
    while True:
        if labels is None:
            own = members.withColumn("comp", F.col("doc"))
            best = own.groupBy("bucket").agg(F.max(F.struct("weight", "pos", "doc", "n", "i")).alias("b"))
            lead = materialise(best.select("bucket", F.col("b.doc").alias("p"), F.col("b.n").alias("np"), F.col("b.i").alias("ip"), F.col("b.weight").alias("wp"), F.col("b.pos").alias("pp")), "jaccard-first")
            pairs = own.join(maybe_broadcast(lead), "bucket").filter(f"doc <> p and {bound}")
            # Each class with its best partner only; the same leads come again with the next ones.
            pairs = pairs.groupBy("doc").agg(F.max(F.struct("wp", "pp", "p", "np", "n")).alias("b")).select("doc", "b.n", "b.p", "b.np")
        else:
            own = members.join(maybe_broadcast(labels), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
            parted = own.groupBy("bucket").agg((F.min("comp") < F.max("comp")).alias("open")).filter("open").select("bucket")
            own = materialise(own.join(maybe_broadcast(materialise(parted, "jaccard-parted")), "bucket", "left_semi"), "jaccard-open")
            lead = own.filter((F.col("pos") * F.col("width") >= least) & (F.col("pos") * F.col("width") < partners))
            lead = lead.select("bucket", F.col("doc").alias("p"), F.col("n").alias("np"), F.col("i").alias("ip"), F.col("comp").alias("cp"), F.col("pos").alias("pp"))
            pairs = own.join(maybe_broadcast(lead), "bucket").filter(f"comp <> cp and {bound}").filter(place[0] > place[1])
            pairs = pairs.select("doc", "n", "p", "np").distinct()
            least = partners
        pairs = materialise(_likely(pairs, prefixes, num, den), "jaccard-pairs")
        linked = _verify(profiles, pairs, num, den)
        if linked is not None:
            if labels is None:
                labels = materialise(components(linked.select(F.col("doc").alias("u"), F.col("p").alias("v"))).select(F.col("u").alias("doc"), F.col("root").alias("comp")), "jaccard-labels")
            else:
                of = lambda c, new: linked.select(F.col(c).alias("doc"), "pair").join(labels, "doc", "left").select("pair", F.coalesce("comp", "doc").alias(new))
                linked = linked.withColumn("pair", F.struct("doc", "p"))
                roots = components(of("doc", "u").join(of("p", "v"), "pair").select("u", "v"))
                roots = roots.select(F.col("u").alias("comp"), "root")
                renamed = labels.join(roots, "comp", "left").select("doc", F.coalesce("root", "comp").alias("comp"))
                fresh = roots.select(F.col("comp").alias("doc"), F.col("root").alias("comp")).join(labels, "doc", "left_anti")
                labels = materialise(renamed.unionByName(fresh), "jaccard-labels")
        elif labels is None:
            labels = profiles.sparkSession.createDataFrame([], "doc long, comp long")
        if least and not own.filter(F.col("pos") * F.col("width") >= least).limit(1).count():
            return labels
        partners *= 4


def linked_rows(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc, th, n, first_doc, first_th of every row: its key (doc_id, NULL_ID for null, and the hash of its text), its set's size, and the least key of its component."""
    text = F.coalesce("text", F.lit(""))
    rows = small_batches(documents).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("th"))
    sets, grams, seed = _sets(rows, size)
    classes = materialise(sets.groupBy("s1").agg(F.min(F.struct("doc", "th")).alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "jaccard-classes")
    copied = classes.filter("copies > 1").select("s1", "rep", "copies")
    copies = sets.join(maybe_broadcast(copied), "s1").filter(F.struct("doc", "th") != F.col("rep")).select("doc", "th").distinct()
    single = rows.join(maybe_broadcast(materialise(copies, "jaccard-copies")), ["doc", "th"], "left_anti")
    if sets.groupBy("doc", "th").count().filter("count > 1").limit(1).count():
        single = single.dropDuplicates(["doc", "th"])
    total = classes.agg(F.sum("n")).first()[0] or 0
    hot = grams.groupBy("s1").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(HOT, int(total * HOT_SHARE))).select("s1")
    hot = np.sort(np.array([r["s1"] for r in hot.collect()], np.int64).view(np.uint64))  # 1 / HOT_SHARE numbers at most
    parts = LEAST_PARTS
    while parts * PART < total and parts < 1 << 24:
        parts *= 2
    profiles = _profiles(single, hot, parts, seed, size, num, den)
    labels = _components(profiles, num, den)
    # Components are named by their least key; classes without links by their own.
    inside = materialise(labels.unionByName(labels.select(F.col("comp").alias("doc"), "comp").distinct()).join(classes.select(F.col("s1").alias("doc"), "rep"), "doc"), "jaccard-inside")
    names = inside.groupBy("comp").agg(F.min("rep").alias("first"))
    named = inside.join(maybe_broadcast(materialise(names, "jaccard-names")), "comp").select(F.col("doc").alias("s1"), "first")
    fate = copied.join(named, "s1", "full_outer").select("s1", F.coalesce("first", "rep").alias("first"))
    out = sets.join(maybe_broadcast(materialise(fate, "jaccard-fate")), "s1", "left")
    key = F.struct("doc", "th")
    out = out.withColumn("first", F.when(F.col("n") > 0, F.coalesce("first", key)).otherwise(key))
    return out.select("doc", "th", "n", F.col("first.doc").alias("first_doc"), F.col("first.th").alias("first_th"))


def link(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: documents whose sets' Jaccard similarity is num/den or more are linked, and a component is named by its least doc_id."""
    out = linked_rows(documents, size, num, den)
    return out.select(F.nullif(F.col("doc"), F.lit(NULL_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.col("first_doc"), F.lit(NULL_ID)).alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), 4, 85, 100)


def keep_one(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component: that with the least doc_id, of several the one whose text hashes least; of repeated rows one. Documents without words are all kept."""
    rows = materialise(linked_rows(documents, size, num, den), "linked")
    gone = rows.filter("doc <> first_doc or th <> first_th").select("doc", "th").distinct()
    of = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce("text", F.lit("")))]
    keyed = documents.select(F.struct(*documents.columns).alias("row"), of[0].alias("doc"), of[1].alias("th"))
    kept = keyed.join(maybe_broadcast(materialise(gone, "near-copies")), ["doc", "th"], "left_anti")
    repeated = rows.filter("n > 0").groupBy("doc", "th").count().filter("count > 1").select("doc", "th")
    repeated = materialise(repeated, "repeated")
    if repeated.limit(1).count():
        many = maybe_broadcast(repeated)
        kept = kept.join(many, ["doc", "th"], "left_anti").unionByName(kept.join(many, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]))
    return kept.select("row.*")
