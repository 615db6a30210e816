"""Postings packed as bytes: read back they are what they were, and little is shuffled."""

import random

import numpy as np
import pyarrow as pa
import pytest

from siltstone.operators import index, packing
from tests.test_store import _shuffled


def test_numbers_as_bytes():
    value = np.array([0, 1, 127, 128, 16_383, 16_384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 31) - 1])
    data, starts = packing._bytes(value)
    back, at = packing._numbers(data)
    assert back.tolist() == value.tolist() and at.tolist() == starts.tolist()
    assert len(packing._numbers(packing._bytes(value[:0])[0])[0]) == 0


def test_broken_postings_are_an_error():
    one = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["h"]), pa.array(["x y"]), pa.array([""]), pa.array(["z z"])], ["id", "hash", "filepath", "title", "body"])
    whole = [b for b in packing.pack(3, True, 64, 2, -1)(iter([one])) if b.num_rows]
    rows = [r for b in packing.unpack(["f", "t", "b", ""])(iter(whole)) for r in b.to_pylist()]
    assert sorted((r["term"], r["field"], r["n"], r["length"], r["positions"], r["hash"]) for r in rows) == [("", "", 0, 4, [], "h"), ("x", "f", 1, 4, [0], None), ("y", "f", 1, 4, [1], None), ("z", "b", 2, 4, [0, 1], None)]
    cut = whole[-1].set_column(5, "terms", pa.array([""] * whole[-1].num_rows))
    with pytest.raises(ValueError, match="broken"):
        list(packing.unpack(["f", "t", "b", ""])(iter([cut])))


def test_packed_postings_are_small(spark):
    """Less is shuffled than by a row a term, long texts and null fields included, and the same comes back."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopé", k=7)) for _ in range(5000)]
    rows = [(f"vault://c/n{k}.md", f"h{k}", f"c/n{k}.md", None if k % 9 == 0 else f"Title {k}", " ".join(rng.choices(words, k=20_000 if k == 7 else 400))) for k in range(50)]
    d = spark.createDataFrame(rows, "id string, hash string, filepath string, title string, body string")
    old, packed = index.written_postings(d.fillna("")), index.packed_postings(d)
    key = lambda r: (r["id"], r["field"], r["term"])
    assert sorted(index.unpacked_postings(packed).collect(), key=key) == sorted(old.collect(), key=key)
    at = _shuffled(spark)[1]
    old.repartition(4, "bucket").write.format("noop").mode("overwrite").save()
    wide, at = _shuffled(spark, at)
    packed.repartition(4, "bucket").write.format("noop").mode("overwrite").save()
    assert _shuffled(spark, at)[0] < 0.6 * wide
