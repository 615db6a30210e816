"""What the operators on vectors share: integer components, rows packed as blocks, exact products, ordered top-k of a tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialise, released

#: Bytes of a packed block of rows at most, at eight bytes a component.
BLOCK_BYTES = 8 << 20
#: A score that no product has: what is left out of a choice.
NEVER = np.iinfo(np.int64).min


def integer_rows(vectors: DataFrame, vector: str = "embedding", **kept: Column | str) -> DataFrame:
    """row (a number of its own for every row, repeated ones too), what is kept, c array<bigint>: floor(256 * x) of each component x.

    Rows whose vector is null or holds a null or non-finite component are left out. An empty vector is the zero vector. Components are held within the root of (2^63 - 1) / length, so that no inner product leaves 64 bits. Written to the shared folder, so that row stays what it is."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    most = F.floor(F.sqrt(F.lit(9.223372e18) / F.greatest(F.size(vector), F.lit(1))))
    c = F.transform(x, lambda v: F.least(F.greatest(F.floor(v * 256), -most), most))
    named = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in kept.items()]
    return materialise(vectors.filter(sound).select(F.monotonically_increasing_id().alias("row"), *named, c.alias("c")), "vector-rows")


def part_of(parts: Column | int) -> Column:
    """Which of so many parts a row falls into."""
    return F.pmod(F.xxhash64("row"), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def packed(rows: DataFrame, keys: list[str], longs: list[str], block_rows: int) -> DataFrame:
    """Blocks of the rows (row, vec_id, c, keys int, longs bigint) of equal keys: keys, piece, n, dim, width, then as bytes row, vec_id, absent (of vec_id), longs, and mat, the components by row in `width` bytes each.

    A block is in the order of vec_id (nulls last), then row; a key with over block_rows rows gives several pieces. A task holds one block."""
    of = ["row", "vec_id", *longs]
    schema = ", ".join([f"{k} int" for k in [*keys, "piece", "n", "dim", "width"]] + [f"{c} binary" for c in [*of, "absent", "mat"]])

    def block(key: tuple, piece: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t["c"].combine_chunks()
        lengths = np.diff(np.asarray(lists.offsets))
        n, dim = len(lengths), int(lengths.max())
        flat = np.asarray(lists.flatten(), np.int64)
        mat = np.zeros((n, dim), np.int64)
        mat[np.arange(dim) < lengths[:, None]] = flat
        top = int(np.abs(flat).max()) if len(flat) else 0
        width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        values = [np.asarray(t[c].combine_chunks().fill_null(0), np.int64).tobytes() for c in of]
        absent = np.asarray(t["vec_id"].combine_chunks().is_null()).astype(np.uint8).tobytes()
        cells = [*key, piece, n, dim, width, *values, absent, mat.astype(f"i{width}").tobytes()]
        ints = len(keys) + 4
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if i < ints else pa.binary()) for i, v in enumerate(cells)], names=[*keys, "piece", "n", "dim", "width", *of, "absent", "mat"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece, held, size = None, 0, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([np.asarray(b.column(c), np.int64) for c in keys], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(k[lo].tolist())
                if key != at:
                    if size:
                        yield block(at, piece, held)
                    at, piece, held, size = key, 0, [], 0
                while lo < hi:
                    take = min(hi - lo, block_rows - size)
                    held.append(b.slice(lo, take))
                    lo, size = lo + take, size + take
                    if size == block_rows:
                        yield block(at, piece, held)
                        piece, held, size = piece + 1, [], 0
        if size:
            yield block(at, piece, held)

    dealt = rows.select(*keys, *of, "c").repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("vec_id"), "row")
    return dealt.mapInArrow(run, schema)


def longs(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.int64)


def matrix(mat: bytes, n: int, dim: int, width: int) -> np.ndarray:
    return np.frombuffer(mat, f"i{width}").reshape(n, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a's rows times b's as int64, exact: in floating point where every partial sum is an integer below 2^53, else in integers. Missing components are zeros."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not d or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if d * float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores in each row, ties to the first column; NEVER is no score. Overwrites scores."""
    rows, columns, every = [], [], np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        has = scores[every, at] > NEVER
        if not has.any():
            break
        rows.append(every[has])
        columns.append(at[has])
        scores[every, at] = NEVER
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(columns)


def nullable(values: np.ndarray, absent: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=absent.astype(bool))
