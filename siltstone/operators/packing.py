"""Postings of a document and bucket as one row of bytes, made and read back a batch at a time by arithmetic on numbers of terms."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltstone.batches import released
from siltstone.functions.analyzer import MEMO, stem

#: How a document's own row is packed: one entry, of no letter, in no field and without places.
OWN_NUMBERS = bytes([1, 0, 3])


def pack(fields: int, stems: bool, buckets: int, letters: int, own: int) -> Callable:
    """A function over batches (id, hash, a column a field: lists of terms, or texts with a space between terms) to (bucket, id, hash, length, numbers, terms): a row a document and bucket, and the document's own row. terms are the entries' terms one after the other; numbers, seven bits a byte, are how many entries there are, the bytes of each one's term, four times the number of its places plus its field, and all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "id", "hash", "length", "numbers", "terms"]
        memo: dict[str, str] = {}  # over a task's batches

        def known(term: str) -> str:
            if len(memo) >= MEMO:
                memo.clear()
            found = memo[term] = stem(term)
            return found

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            split = pa.types.is_string(b.column(2).type)
            lists = [pc.split_pattern(pc.fill_null(c, ""), " ") if split else c for c in b.columns[2:]]
            sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]
            row = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
            place = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for s in sizes])
            field = np.repeat(np.arange(fields), [s.sum() for s in sizes])
            encoded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            words, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            none = pc.index(words, "").as_py() if split else -1
            if none >= 0:  # a text without words
                ok = code != none
                row, place, field, code = row[ok], place[ok], field[ok], code[ok]
            length = pa.array(np.bincount(row, minlength=n), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, own), pa.int32()), b.column(0), b.column(1), length, pa.array([OWN_NUMBERS] * n, pa.binary()), pa.array([""] * n, pa.string())], names)
            if not len(code):
                continue
            if stems:
                stemmed = pa.array([memo.get(w) or known(w) for w in words.to_pylist()], pa.string()).dictionary_encode()
                words, code = stemmed.dictionary, stemmed.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
            bucket = np.array([zlib.crc32(w[:letters].encode()) % buckets for w in words.to_pylist()], np.int64)
            key = ((row * buckets + bucket[code]) * len(words) + code) * fields + field
            order = np.argsort(key, kind="stable")  # places stay in order
            key, place = key[order], place[order]
            entry = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # where each term of a document, bucket and field begins
            times, at = np.diff(np.append(entry, len(key))), key[entry]
            of = at // fields // len(words)  # document and bucket
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            m = np.diff(np.append(first, len(of)))
            terms = words.take(pa.array(at // fields % len(words)))
            ends = np.frombuffer(terms.buffers()[1], np.int32)[: len(terms) + 1]
            places = np.diff(np.append(entry[first], len(key)))
            base = np.cumsum(1 + 2 * m + places) - (1 + 2 * m + places)
            value = np.empty(int(base[-1] + 1 + 2 * m[-1] + places[-1]), np.int64)
            value[base] = m
            to = np.repeat(base + 1, m) + np.arange(len(at)) - np.repeat(first, m)
            value[to] = np.diff(ends)
            value[to + np.repeat(m, m)] = times * 4 + at % fields
            value[np.repeat(base + 1 + 2 * m, places) + np.arange(len(key)) - np.repeat(entry[first], places)] = place
            data, starts = _bytes(value)
            numbers = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.append(starts[base], len(data)).astype(np.int32)), pa.py_buffer(data)])
            joined = pa.StringArray.from_buffers(len(m), pa.py_buffer(ends[np.append(first, len(at))].copy()), terms.buffers()[2] or pa.py_buffer(b""))
            doc = pa.array(of[first] // buckets)
            yield pa.RecordBatch.from_arrays([pa.array(of[first] % buckets, pa.int32()), b.column(0).take(doc), pa.nulls(len(m), b.column(1).type), length.take(doc), numbers, joined], names)

    return released(run)


def _bytes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2^35, seven bits a byte, the lowest first; and where each begins."""
    size = 1 + sum((value >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    starts = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(5):
        ok = np.flatnonzero(size > k)
        v = value[ok] >> 7 * k
        out[starts[ok] + k] = (v & 127) | np.where(size[ok] > k + 1, 128, 0)
    return out, starts


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What _bytes made bytes of; and where each begins."""
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    size, value = ends - starts + 1, np.zeros(len(ends), np.int64)
    for k in range(5):
        ok = np.flatnonzero(size > k)
        value[ok] |= (data[starts[ok] + k].astype(np.int64) & 127) << 7 * k
    return value, starts


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a column of strings or bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def unpack(names: list[str]) -> Callable:
    """A function over batches of what pack makes, names being the fields' and that of none, to (bucket, term, id, hash, field, n, length, positions). An error, if numbers and terms don't fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, data = _buffers(b.column(4))
            value, starts = _numbers(data)
            begin = np.searchsorted(starts, at)
            m = value[begin[:-1]]
            row = np.repeat(np.arange(b.num_rows), m)
            to = begin[row] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            size, told = value[to], value[to + m[row]]
            sizes = np.diff(begin)
            places = value[np.arange(len(value)) - np.repeat(begin[:-1], sizes) >= np.repeat(1 + 2 * m, sizes)]
            ends, lists = (np.append(0, np.cumsum(x)) for x in (size, told >> 2))
            letters = _buffers(b.column(5))[1]
            if ends[-1] != len(letters) or lists[-1] != len(places):
                raise ValueError("packed postings are broken")
            term = pa.StringArray.from_buffers(len(row), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))
            positions = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(places, pa.int32()))
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), term, b.column(1).take(of), b.column(2).take(of), pa.array(names).take(pa.array(told & 3)), pa.array(told >> 2, pa.int32()), b.column(3).take(of), positions], ["bucket", "term", "id", "hash", "field", "n", "length", "positions"])

    return released(run)
