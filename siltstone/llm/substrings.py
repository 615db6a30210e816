"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts earlier are removed, over all documents.

Threshold-bounded interval expansion decides which strings are equal: starting from the empty string, breadth-first backward extension on a Burrows-Wheeler transform splits suffix intervals by the character before them, which derives common prefixes by increasing value; it stops at `length`, so what is then still in one interval has a common prefix of at least that. The transform needs its suffixes in order, which says nothing yet of where common prefixes end; the borders come from the expansion alone, and no byte is removed without it.

Which strings have to meet in a transform is settled by their own bytes. Each window of `length` bytes has an anchor, its least-hashed GRAM-byte string (the leftmost of equals); windows in a row with one anchor form a segment. Equal windows have equal anchors at equal places.

1. Slices of the texts are searched for segments that repeat in them. Runs of such segments and what they repeat go through a transform on the spot, so that a passage in a third of all documents leaves one row a slice; the first of each distinct segment goes on, as hashes and a place.
2. Rows meet by anchor. Of segments that look alike (equal hashes) the first is told to be so, and the others who it is; their documents send the bytes of whole runs of such segments to meet at the first one's place, PEERS copies at a time, for the transform to decide. Where an anchor has several different segments, the firsts are candidates: a window holds the `half` bytes before its anchor or those after it, so a segment goes as two pieces by the hash of the anchor with that side. Of anchors with more than HOT such segments each window is a piece of its own and goes by its own hash, so that a common string shorter than `length` brings nothing together.
3. Pieces meet by hash, in order, a transform's block at a time. A block carries on what the blocks before it could not remove; where that grows too large, the windows are sorted by hash and blocks hold windows.

Rows of one task are sorted by Spark (which spills) and read key by key. Documents are shuffled by their key once; both joins use that exchange.

Edge cases: null and empty texts have no bytes and no spans; texts shorter than `length` lose nothing; order is (doc_id, start), null ids first; rows that share a doc_id but not their text are documents in the order of their texts' hashes, identical rows with one doc_id count as the same document; no rows give no rows; further columns are ignored. length is at most 4095."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, released, table

LENGTH = 100
#: Bytes of an anchor; a window of 100 has 64 places for it.
GRAM = 37
#: Bytes whose anchors are looked for at a time (a longer text goes in overlapping parts), and that a transform holds at a time.
CHUNK, BLOCK = 1 << 20, 1 << 20
#: Bytes of texts that are searched for repeats before anything is shuffled.
SLICE = 1 << 24
#: Rows of an anchor beyond which each of its windows goes by its own hash.
HOT = 50_000
#: Bytes of a first document that its copies meet at, and how many copies meet there at a time.
CELL, PEERS = 1 << 12, 1000
#: Windows that are compared at a time before they are shuffled.
WINDOWS = 40_000
M1, M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: What a mark says of a place: removed, go by either side of the anchor, go window by window, go with what looks alike first (peer, place), be that.
DUP, SIDES, EACH, COPY, FIRST = 0, 1, 2, 3, 4
#: Low bits of an anchor's sort key that hold its place.
PLACE = 24


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(M2)
    x ^= x >> np.uint64(29)
    x *= np.uint64(M1)
    x ^= x >> np.uint64(32)
    return x


#: By hash: a random digit for each byte, the base, and the powers of the base and its inverse as far as they were needed.
_BASES = [(_mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * (k + 1))), base, [np.ones(1, np.uint64), np.ones(1, np.uint64)]) for k, base in enumerate((0x5851F42D4C957F2D, 0xDA3E39CB94B95BDB))]


class Ranges:
    """Hashes of byte ranges that depend on their bytes only, 64 bits a part: polynomial sums, shifted to place 0 and mixed."""

    def __init__(self, data: np.ndarray, parts: int = 2):
        n = len(data)
        self.parts = []
        for digits, base, powers in _BASES[:parts]:
            if len(powers[0]) <= n:
                for k, b in enumerate((base, pow(base, -1, 1 << 64))):
                    p = np.full(n + n // 8 + 1, b, np.uint64)
                    p[0] = 1
                    powers[k] = np.multiply.accumulate(p)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(digits[data] * powers[0][:n], out=sums[1:])
            self.parts.append((sums, powers[1]))

    def of(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        sums, down = self.parts[k]
        return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(M1))

    def every(self, size: int) -> np.ndarray:
        """of() for the ranges of one size from every place."""
        sums, down = self.parts[0]
        n = len(sums) - 1
        return _mix((sums[size:] - sums[:-size]) * down[: n - size + 1] + np.uint64(size * M1 & (1 << 64) - 1))


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts one after the other in data, each up to its end: anchor's hash and place, segment hash, start and end of every segment; fewer than 2^PLACE bytes."""
    window = length - gram + 1
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.uint64, np.int64, np.int64))
    hashes = Ranges(data)
    h = hashes.every(gram)
    # Least hash in each window, leftmost of equals: the place rides in the low bits, which the hash gives up.
    least = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: size - window], least[window - size :])
    place = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    inside = np.ones(len(place), bool)  # windows that no end cuts
    for k in ends[:-1]:
        inside[max(0, k - length + 1) : k] = False
    at = np.flatnonzero(inside)
    place = place[at]
    if not len(at):
        return segments(data[:0], ends)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    start, end = at[new], at[np.r_[new[1:], len(at)] - 1] + length
    return h[place[new]], place[new], hashes.of(start, end, 1), start, end


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of text (numbers under 2^15, not negative) sorted by at least `length` characters, by doubling from packed characters; ties in any order."""
    n = len(text)
    used = np.zeros(int(text.max()) + 1, bool)
    used[text] = True
    text = (np.cumsum(used) - 1)[text]
    bits = max(1, int(text.max() + 1).bit_length())
    text = (text + 1).astype(np.uint64)  # what lies beyond the end is 0
    wide = n.bit_length()
    # A key holds its suffix's place in the low bits, so that sorting numbers is enough: several times as fast as sorting places by them.
    low, mask = np.uint64(wide), np.uint64((1 << wide) - 1)
    if 3 * wide > 64:
        raise ValueError("a transform holds 2^21 characters at most")
    k = min(length, (64 - wide) // bits)
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key <<= np.uint64(bits)
        key[: n - j] |= text[j:] if j else text
    places = np.arange(n, dtype=np.uint64)
    while True:
        s = np.sort(key << low | places)
        order = (s & mask).astype(np.int32)
        if k >= length or k >= n:
            return order
        s >>= low
        new = np.ones(n, np.uint64)
        np.cumsum(s[1:] != s[:-1], out=new[1:])
        new[1:] += np.uint64(1)
        if new[-1] == n:
            return order
        rank = s
        rank[order] = new
        key = rank << low
        key[: n - k] |= rank[k:]
        k *= 2


def expand(parts: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of the parts, each followed by a separator, in order, and the borders between those that differ within `length` bytes.

    Threshold-bounded interval expansion: `border[i]` is set when the common prefix of suffixes i-1 and i is known to be shorter than `length`; each round extends the intervals of strings of one length backward by every character before them, and a border found for the first time at round l marks a common prefix of l. An interval whose right border was known can't lead to a new one, so it isn't extended again, and over all rounds no more intervals are extended than there are suffixes. Separators extend nothing."""
    n = sum(len(p) + 1 for p in parts)
    text = np.zeros(n, np.int16)
    i = 0
    for p in parts:
        text[i : i + len(p)] = p
        text[i : i + len(p)] += 1
        i += len(p) + 1
    order = suffix_order(text, length)
    before = text[order - 1]  # the transform; the first suffix is preceded by the last separator
    by_letter = np.argsort(before, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)  # the row of the suffix that is one character longer
    step[by_letter] = np.arange(n, dtype=np.int32)
    same = before[by_letter[1:]] == before[by_letter[:-1]]
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[by_letter[:-1][same]] = by_letter[1:][same]
    preceding[by_letter[1:][same]] = by_letter[:-1][same]
    del by_letter, same
    solid = before > 0
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    lo, hi = np.array([0], np.int64), np.array([n], np.int64)
    for _ in range(length):
        if not len(lo):
            break
        sizes = hi - lo
        one = sizes == 1
        rows = lo[one]
        rows = rows[solid[rows]]
        lefts, rights = [step[rows]], [step[rows] + 1]
        lo, hi, sizes = lo[~one], hi[~one], sizes[~one]
        # In each wider interval the rows that are the first, and the last, of their character: a child's ends.
        for a in _groups(sizes):
            w = sizes[a]
            inside = np.repeat(lo[a] - np.r_[0, np.cumsum(w)[:-1]], w) + np.arange(w.sum())
            first = inside[(preceding[inside] < np.repeat(lo[a], w)) & solid[inside]]
            last = inside[(following[inside] >= np.repeat(hi[a], w)) & solid[inside]]
            owner = np.searchsorted(lo[a], np.r_[first, last], side="right").astype(np.int64) << 32 | np.r_[step[first], step[last]]
            lefts.append(np.sort(owner[: len(first)]) & 0xFFFFFFFF)
            rights.append((np.sort(owner[len(first) :]) & 0xFFFFFFFF) + 1)
        left, right = np.concatenate(lefts), np.concatenate(rights)
        new = ~border[right]
        border[right[new]] = True
        both = np.sort(left[new].astype(np.int64) << 32 | right[new])
        lo, hi = both >> 32, both & 0xFFFFFFFF
    return order, border


def _groups(sizes: np.ndarray, most: int = 1 << 19) -> list[slice]:
    """Slices of about `most` rows, so that what an interval's rows take is bounded."""
    if not len(sizes):
        return []
    total = np.cumsum(sizes)
    cuts = np.searchsorted(total, np.arange(most, int(total[-1]) + most, most)) + 1
    ends = np.unique(np.minimum(cuts, len(sizes)))
    return [slice(a, z) for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True) if z > a]


def first_runs(parts: list[np.ndarray], doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(part, from, to): runs of places in each part whose string of `length` bytes starts earlier in another place; parts are in any order."""
    sizes = np.array([len(p) for p in parts])
    offset = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    order, border = expand(parts, length)
    rows = np.flatnonzero(~(border[:-1] & border[1:]))  # suffixes that are not alone
    pos = order[rows]
    part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + 1)
    own = part[pos]
    fits = pos + length <= (offset + sizes)[own]
    rows, pos, own = rows[fits], pos[fits], own[fits]
    if not len(rows):
        return []
    klass = np.cumsum(border[:-1])[rows]
    head = np.flatnonzero(np.r_[True, klass[1:] != klass[:-1]])
    # A place as one number, in the order of places: a text is shorter than 2^32.
    where = (np.unique(doc, return_inverse=True)[1].astype(np.int64)[own] << 32) + start[own] + pos - offset[own]
    first = np.repeat(np.minimum.reduceat(where, head), np.diff(np.r_[head, len(where)]))
    # The same place in two overlapping pieces of one document is one string, not two.
    later = np.zeros(len(part), bool)
    later[pos[where > first]] = True
    hit = np.flatnonzero(later)
    if not len(hit):
        return []
    cut = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (part[hit[1:]] != part[hit[:-1]])])
    ends = np.r_[cut[1:], len(hit)] - 1
    of = part[hit[cut]]
    return list(zip(of.tolist(), (hit[cut] - offset[of]).tolist(), (hit[ends] - offset[of]).tolist(), strict=True))


def _merge(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the intervals of each document: doc, start, end."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    group = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])])
    return doc[new], start[new], reach[np.r_[new[1:], len(doc)] - 1]


#: Pieces of texts: their bytes, documents and starts.
Pieces = tuple[list[bytes], np.ndarray, np.ndarray]


def decide(pieces: Pieces, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start and end of what an earlier equal string among the pieces removes, a transform's block at a time."""
    parts, doc, start = pieces
    out = [(np.zeros(0, np.int64),) * 3]

    def run(own: list[bytes], d: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Places removed in each piece; adds them to out."""
        found = first_runs([np.frombuffer(p, np.uint8) for p in own], d, s, length)
        gone = np.zeros(len(own), np.int64)
        if found:
            p, a, z = np.array(found, np.int64).T
            out.append((d[p], s[p] + a, s[p] + z + length))
            np.add.at(gone, p, z - a + 1)
        return gone

    sizes = np.array([len(p) for p in parts], np.int64)
    if sizes.sum() <= block:
        if len(parts) > 1 or sizes.sum() > length:
            run(parts, doc, start)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
    carried = np.zeros(0, np.int64)
    order = np.lexsort((start, doc))
    at = 0
    while at < len(order):
        if sizes[carried].sum() > block // 2:
            _by_window(parts, doc, start, [*carried.tolist(), *order[at:].tolist()], run, length, block)
            break
        total = np.cumsum(sizes[order[at : at + block // length]])
        more = order[at : at + max(1, int(np.searchsorted(total, block // 2, side="right")))]
        at += len(more)
        rows = np.r_[carried, more]
        gone = run([parts[k] for k in rows], doc[rows], start[rows])
        # What the block removed altogether has its equals before it.
        carried = rows[gone < sizes[rows] - length + 1]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _by_window(parts: list[bytes], doc: np.ndarray, start: np.ndarray, rows: list[int], run, length: int, block: int) -> None:
    """The pieces' windows by hash, so that only equal ones share a block; one hash's windows beyond a block meet its first."""
    hashes = [Ranges(np.frombuffer(parts[k], np.uint8), 1).every(length) for k in rows if len(parts[k]) >= length]
    rows = [k for k in rows if len(parts[k]) >= length]
    many = [len(h) for h in hashes]
    h, piece = np.concatenate(hashes), np.repeat(rows, many)
    local = np.arange(len(h)) - np.repeat(np.cumsum(many) - many, many)
    by = np.lexsort((start[piece] + local, doc[piece], h))
    h, piece, local = h[by], piece[by], local[by]
    new = np.r_[True, h[1:] != h[:-1]]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    several = ~new | np.r_[~new[1:], False]
    step = max(2, block // (length + 1))
    use = np.flatnonzero(several)
    for a in range(0, len(use), step):
        own = use[a : a + step]
        if head[own[0]] != own[0]:
            own = np.r_[head[own[0]], own]
        run([parts[k][i : i + length] for k, i in zip(piece[own].tolist(), local[own].tolist(), strict=True)], doc[piece[own]], start[piece[own]] + local[own])


def _spread(doc: np.ndarray) -> np.ndarray:
    return _mix(doc.astype(np.uint64)).view(np.int64)


def _cells(start: np.ndarray, end: np.ndarray, cell: int, length: int) -> tuple[np.ndarray, ...]:
    """Intervals cut by the cell, of `cell` bytes, that a window of theirs starts in: number of the interval, cell, start, end."""
    first, last = start // cell, (end - length) // cell
    many = last - first + 1
    k = np.repeat(np.arange(len(start)), many)
    c = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + first[k]
    return k, c, np.maximum(start[k], c * cell), np.minimum(end[k], (c + 1) * cell + length - 1)


def _runs(b: np.ndarray, e: np.ndarray, a: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping segments [b, e) in a row, each of which looks like the one at a, as one: number of a segment of the run, b, e, a."""
    by = np.lexsort((b, b - a, *same))
    b, e, a = b[by], e[by], a[by]
    new = np.r_[True, (b[1:] - a[1:] != b[:-1] - a[:-1]) | (b[1:] >= e[:-1])]
    for x in same:
        new[1:] |= x[by][1:] != x[by][:-1]
    new = np.flatnonzero(new)
    return by[new], b[new], np.maximum.reduceat(e, new), a[new]


def _met(doc: np.ndarray, cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return _mix(_mix(doc.astype(np.uint64)) + _mix(cell.astype(np.uint64)) * np.uint64(M1) + salt.astype(np.uint64) * np.uint64(M2))


def _repeats(data: bytes, b: np.ndarray, e: np.ndarray, a: np.ndarray, doc_at: np.ndarray, doc: np.ndarray, start_at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """What the transform removes of the segments [b, e) of data, each of which looks like the one at a; doc and start of the texts from doc_at on.

    Segments that repeat others in a row are one run. Runs are cut where what they repeat passes a multiple of a block's quarter, and meet by that place."""
    _, b, e, a = _runs(b, e, a)
    k, c, low, high = _cells(a, a + e - b, max(length, BLOCK // 4), length)
    # What is repeated, once for each cell, and the runs that repeat it.
    texts = len(doc_at)
    where, x, y = _merge(low, high, c * texts + np.searchsorted(doc_at, low, side="right") - 1)
    cells, x, y = np.r_[where // texts, c], np.r_[x, b[k] + low - a[k]], np.r_[y, b[k] + high - a[k]]
    by = np.argsort(cells, kind="stable")
    cells, x, y = cells[by], x[by], y[by]
    text = np.searchsorted(doc_at, x, side="right") - 1
    own, begin = doc[text], x - doc_at[text] + start_at[text]
    bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    out, held, size = [], 0, 0
    for i, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        size += int((y[i:z] - x[i:z]).sum())
        if size >= BLOCK // 2 or z == len(x):
            out.append(decide(([data[p:q] for p, q in zip(x[held:z].tolist(), y[held:z].tolist(), strict=True)], own[held:z], begin[held:z]), length))
            held, size = z, 0
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _by_key(batches: Iterator, least: int) -> Iterator[dict]:
    """Columns of rows sorted by key, at least `least` rows at a time, no key in two."""
    import pyarrow as pa

    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        key = b.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if not cut and len(held) > 1 and held[-2].column("key")[-1].as_py() == key[-1]:
            continue
        whole = pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
        if whole.num_rows:
            yield whole
        held, rows = [b.slice(cut)], b.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


NULL_ID = -(1 << 63)


def keyed(documents: DataFrame) -> DataFrame:
    """doc, doc_id, text: doc is a number in the order of (doc_id, null first, hash of the text) that only identical rows share: doc_id itself where none is null or repeated."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if not documents.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        return rows.select(F.col("doc_id").cast("long").alias("doc"), "doc_id", "text")
    rows = rows.withColumn("th", F.xxhash64("text"))
    names = rows.select(F.struct("doc_id", "th").alias("name")).distinct().repartitionByRange("name").withColumn("block", F.spark_partition_id())
    names = materialise(names, "document-names")
    before, at = [], 0
    for r in names.groupBy("block").agg(F.count("*").alias("n")).orderBy("block").collect():  # a row a partition
        before.append((r["block"], at))
        at += r["n"]
    of = F.broadcast(documents.sparkSession.createDataFrame(before or [(0, 0)], "block int, before long"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("name"))
    numbered = names.join(of, "block").select("name", (F.col("before") + rank).alias("doc"))
    return materialise(rows.withColumn("name", F.struct("doc_id", "th")).join(numbered, "name").select("doc", "doc_id", "text"), "document-keys")


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of start, end in bytes) and kept (the remaining bytes); with digests kept_sha256 in place of the last two."""
    import pyarrow as pa

    half = (length - gram) // 2

    def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    # An anchor's row packs start, segment length and place; a run of removed bytes is -1 - start, with its end for a hash.
    mark = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(texts: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(t) for _, _, t in texts], np.int64)
            doc, first, doc_at = np.array([d for d, _, _ in texts], np.int64), np.array([o for _, o, _ in texts], np.int64), np.cumsum(sizes) - sizes
            data = b"".join(t for _, _, t in texts)
            rows, lo = [], 0
            for k in range(len(texts)):  # CHUNK bytes or a text at a time
                if k + 1 == len(texts) or doc_at[k + 1] + sizes[k + 1] - doc_at[lo] > CHUNK:
                    a, z = int(doc_at[lo]), int(doc_at[k] + sizes[k])
                    h, place, seg, start, end = segments(np.frombuffer(data, np.uint8, z - a, a), np.cumsum(sizes[lo : k + 1]), length, gram)
                    rows.append((h.view(np.int64), seg.view(np.int64), start + a, end + a, place + a))
                    lo = k + 1
            key, seg, start, end, place = (np.concatenate(x) for x in zip(*rows, strict=True))
            text = np.searchsorted(doc_at, start, side="right") - 1
            own, at = doc[text], start - doc_at[text] + first[text]
            by = np.lexsort((at, own, seg, key))
            new = np.r_[True, (key[by][1:] != key[by][:-1]) | (seg[by][1:] != seg[by][:-1])] if len(by) else np.zeros(0, bool)
            i, j, head = by[new], by[~new], by[new][np.cumsum(new) - 1][~new]
            yield batch({"key": key[i], "seg": seg[i], "doc": own[i], "at": at[i] << 24 | (end - start)[i] << 12 | (place - start)[i]}, mark)
            real = (own[j] != own[head]) | (at[j] != at[head])  # a text's parts overlap, and rows repeat
            j, head = j[real], head[real]
            if len(j):
                d, a, e = _repeats(data, start[j], end[j], start[head], doc_at, doc, first, length)
                d, a, e = _merge(a, e, d)
                yield batch({"key": _spread(d), "seg": e, "doc": d, "at": -1 - a}, mark)

        texts, size = [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_buffer()
                raw = b"" if raw is None else raw.to_pybytes()
                for at in range(0, max(1, len(raw) - length + 1), CHUNK):
                    part = raw[at : at + CHUNK + length - 1]
                    if len(part) >= length:
                        texts.append((d, at, part))
                        size += len(part)
                    if size >= SLICE:
                        yield from flush(texts)
                        texts, size = [], 0
        if texts:
            yield from flush(texts)

    plain = pa.schema([("doc", pa.int64()), ("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("place", pa.int64()), ("peer", pa.int64()), ("salt", pa.int32())])

    def told(doc: np.ndarray, kind: np.ndarray | int, start: np.ndarray, end: np.ndarray, place: np.ndarray | int = 0, peer: np.ndarray | int = 0, salt: np.ndarray | int = 0) -> pa.RecordBatch:
        return batch({k: np.broadcast_to(v, len(doc)) for k, v in zip(plain.names, (doc, kind, start, end, place, peer, salt), strict=True)}, plain)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places whose anchor recurs: of segments that look alike the first, and the others as its copies; the firsts of an anchor that has several, as they are."""
        for t in _by_key(batches, 200_000):
            key, seg, doc, at = (t.column(n).to_numpy() for n in mark.names)
            done = at < 0
            yield told(doc[done], DUP, -1 - at[done], seg[done])
            key, seg, doc, at = key[~done], seg[~done], doc[~done], at[~done]
            if not len(key):
                continue
            by = np.lexsort((at, doc, seg, key))
            key, seg, doc, at = key[by], seg[by], doc[by], at[by]
            start = at >> 24
            end, place = start + (at >> 12 & 4095), start + (at & 4095)
            other = np.r_[True, key[1:] != key[:-1]]
            head = other | np.r_[True, seg[1:] != seg[:-1]]
            of = np.flatnonzero(head)[np.cumsum(head) - 1]
            many = np.diff(np.r_[np.flatnonzero(head), len(key)])
            copy = ~head & ((doc != doc[of]) | (start != start[of]))  # identical rows are one place
            yield told(doc[copy], COPY, start[copy], end[copy], start[of][copy], doc[of][copy], ((np.arange(len(key)) - of - 1) // PEERS)[copy])
            i = np.flatnonzero(head)[many > 1]
            yield told(doc[i], FIRST, start[i], end[i], salt=(many[many > 1] - 2) // PEERS)
            i = np.flatnonzero(head)
            new = np.flatnonzero(other[i])
            kinds = np.diff(np.r_[new, len(i)])
            kinds = np.repeat(kinds, kinds)
            i, kinds = i[kinds > 1], kinds[kinds > 1]
            yield told(doc[i], np.where(kinds > HOT, EACH, SIDES), start[i], end[i], place[i])

    piece = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidates' bytes. Of pieces that are windows only those go on that a transform does not remove here."""
        each: list[tuple[int, int, int, bytes]] = []

        def alone() -> Iterator[pa.RecordBatch]:
            key, doc, start = (np.array(x, np.int64) for x in list(zip(*each, strict=True))[:3])
            d, x, y = decide(([p for *_, p in each], doc, start), length)
            d, x, y = _merge(x, y, d)
            gone = {(i, k) for i, a, z in zip(d.tolist(), x.tolist(), y.tolist(), strict=True) for k in range(a, z - length + 1)}
            yield batch({"key": _spread(d + x), "doc": d, "start": x, "end": y, "bytes": [None] * len(d)}, piece)
            left = [r for r in each if (r[1], r[2]) not in gone]
            yield batch({"key": [r[0] for r in left], "doc": [r[1] for r in left], "start": [r[2] for r in left], "end": [r[2] + length for r in left], "bytes": [r[3] for r in left]}, piece)
            each.clear()

        for b in batches:
            out = {n: [] for n in piece.names}

            def add(d: int, key: np.ndarray, x: np.ndarray, y: np.ndarray, raw: bytes | None) -> None:
                out["key"] += key.view(np.int64).tolist()
                out["doc"] += [d] * len(x)
                out["start"] += x.tolist()
                out["end"] += y.tolist()
                out["bytes"] += [None] * len(x) if raw is None else [raw[u:v] for u, v in zip(x.tolist(), y.tolist(), strict=True)]

            for d, t, marks in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if not marks.is_valid or not len(marks):
                    continue
                m = marks.values
                kind, start, end, place, peer, salt = (m.field(k).to_numpy() for k in range(6))
                _, a, e = _merge(start[kind == DUP], end[kind == DUP], np.zeros((kind == DUP).sum(), np.int64))
                add(d, _spread(np.arange(len(a)) + d), a, e, None)
                if (kind == DUP).all():
                    continue
                raw = t.as_buffer().to_pybytes()
                hashes = Ranges(np.frombuffer(raw, np.uint8), 1)
                own = kind == COPY
                if own.any():
                    # By the place in the first document, so that what is alike there meets without the segments' overlaps.
                    k, x, y, a = _runs(start[own], end[own], place[own], salt[own], peer[own])
                    i, c, low, high = _cells(a, a + y - x, CELL, length)
                    x = x[i] + low - a[i]
                    add(d, _met(peer[own][k[i]], c, salt[own][k[i]]), x, x + high - low, raw)
                own = kind == FIRST
                for r in range(int(salt[own].max()) + 1 if own.any() else 0):
                    use = own & (salt >= r)
                    _, x, y, _ = _runs(start[use], end[use], start[use])
                    _, c, low, high = _cells(x, y, CELL, length)
                    add(d, _met(np.full(len(c), d), c, np.full(len(c), r)), low, high, raw)
                    if len(out["key"]) >= 10_000:
                        yield batch(out, piece)
                        for v in out.values():
                            v.clear()
                own = kind == EACH
                if own.any():
                    many = end[own] - start[own] - length + 1
                    x = np.unique(np.repeat(start[own] - np.cumsum(many) + many, many) + np.arange(many.sum()))
                    for k in range(0, len(x), 10_000):
                        w = x[k : k + 10_000]
                        each.extend(zip(hashes.of(w, w + length, 0).view(np.int64).tolist(), [d] * len(w), w.tolist(), [raw[u : u + length] for u in w.tolist()], strict=True))
                        if len(each) >= WINDOWS:
                            yield from alone()
                start, end, place = start[kind == SIDES], end[kind == SIDES], place[kind == SIDES]
                # windows from w on: those with w <= place - half have the left side, the rest have the right side
                last = end - length
                for x, y, p, q in ((start, np.minimum(last, place - half), place - half, place + gram), (np.maximum(start, place - half + 1), last, place, place + gram + (length - gram - half))):
                    ok = x <= y
                    x, y, p, q = x[ok], y[ok] + length, p[ok], q[ok]
                    add(d, hashes.of(p, q, 0), x, y, raw)
                if len(out["key"]) >= 10_000:
                    yield batch(out, piece)
                    for v in out.values():
                        v.clear()
            yield batch(out, piece)
        if each:
            yield from alone()

    run = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, 5_000):
            real = t.column("bytes").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            key, doc, start, end = (t.column(n).to_numpy() for n in ("key", "doc", "start", "end"))
            yield batch({"doc": doc[~real], "start": start[~real], "end": end[~real]}, run)
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            several = real & np.repeat(np.diff(bounds) > 1, np.diff(bounds))
            if not several.any():
                continue
            parts = t.column("bytes").filter(pa.array(several)).to_pylist()
            key, doc, start = key[several], doc[several], start[several]
            size = np.cumsum([len(p) for p in parts])
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            a = 0
            while a < len(bounds) - 1:  # whole keys, about a block
                z = max(a + 1, int(np.searchsorted(size[bounds[1:] - 1], size[bounds[a]] + BLOCK - length, side="right")))
                lo, hi = int(bounds[a]), int(bounds[z])
                d, x, y = decide((parts[lo:hi], doc[lo:hi], start[lo:hi]), length)
                yield batch({"doc": d, "start": x, "end": y}, run)
                a = z

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if digests else ["spans", "kept"])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, spans, kept = [], [], [], []
            for t, marks in zip(b.column(1), b.column(2), strict=True):
                raw = t.as_buffer()
                raw = b"" if raw is None else raw.to_pybytes()
                own, out, at = [], [], 0
                if marks.is_valid and len(marks):
                    m = marks.values
                    _, a, e = _merge(m.field(0).to_numpy(), m.field(1).to_numpy(), np.zeros(len(m), np.int64))
                    own = list(zip(a.tolist(), e.tolist(), strict=True))
                for x, y in own:
                    out.append(raw[at:x])
                    at = y
                out.append(raw[at:])
                rest = b"".join(out)
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append(own)
                kept.append(hashlib.sha256(rest).hexdigest() if digests else rest)
            head = [b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64())]
            tail = [pa.array(kept, pa.string())] if digests else [pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(head + tail, names)

    docs = keyed(documents)
    found = docs.select("doc", "text").mapInArrow(released(anchors), "key long, seg long, doc long, at long").repartition("key").sortWithinPartitions("key").mapInArrow(released(meet), "doc long, kind byte, start long, end long, place long, peer long, salt int")
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("kind", "start", "end", "place", "peer", "salt")).alias("marks"))
    pieces = docs.join(by_doc.hint("shuffle_hash"), "doc", "left").select("doc", "text", "marks", "doc_id").mapInArrow(released(fetch), "key long, doc long, start long, end long, bytes binary")
    runs = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(released(transform), "doc long, start long, end long")
    spans = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    tail = "kept_sha256 string" if digests else "spans array<struct<start:long,end:long>>, kept binary"
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return docs.join(spans.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "spans").mapInArrow(released(cut), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, {tail}")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)
