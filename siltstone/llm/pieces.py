"""SentencePiece encoding and decoding for merge-type (BPE) models, exactly, by backtracking.

A text is cut where no piece can reach across (before runs of the space mark, around line feeds where the model has none), and each distinct unit is encoded once a worker. Within a unit an Aho-Corasick automaton lists the pieces that start at each place; the longest is taken first, and it may follow the piece before it only if re-merging the two leaves them apart. If no piece fits, the place is marked in a bitfield as failed and the last piece is shortened.
The check of two neighbours walks the right edge of the left piece's merge tree and the left edge of the right one's in order of rank, looking for a merge across the border that would have come first. Pieces whose merge tree isn't in order of rank, and runs of space marks, whose pieces tie in rank, are merged plainly by a heap instead, which is exact for any model.

Edge cases: null and empty texts have no ids and decode to the empty text; characters that are no piece become their bytes' pieces; repeated rows each give a row; no rows give no rows; further columns are ignored. Cached units are bounded, and a unit's work is linear in its length."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import released, small_batches, table

SPACE = "▁"
#: Distinct units a worker keeps; longer ones than CACHED_CHARS are not kept.
CACHED_UNITS, CACHED_CHARS = 80_000, 64
#: Neighbours whose check a worker remembers.
KNOWN_PAIRS = 300_000
#: Rows that go back to Spark at a time.
ROWS = 256


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


class _Kept(dict):
    """A bounded memo of a function in two generations: when the young one is full it becomes the old one, from which what is used again comes back."""

    def __init__(self, of):
        super().__init__()
        self.of, self.old = of, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHED_UNITS:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceCodec:
    def __init__(self, model: bytes):
        import struct

        import ahocorasick

        normal, unknown, control, byte = 1, 2, 3, 6
        self.pieces, self.kinds, scores = [], [], []
        for f, v in _fields(model):
            if f == 1:
                piece = dict(_fields(v))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, normal))
            elif f == 2:
                trainer = dict(_fields(v))
                if trainer.get(3, 1) != 2:
                    raise ValueError("not a BPE model")
            elif f == 3:
                norm = dict(_fields(v))
                if norm.get(1) != b"identity" or norm.get(4, 1):
                    raise ValueError("only the identity normalizer without removal of white space is supported")
                self.prefix = bool(norm.get(3, 1))
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == normal}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == byte}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = self.kinds.index(unknown)
        self.silent = {i for i, k in enumerate(self.kinds) if k == control}
        self.rank = {p: -scores[i] for p, i in self.id.items()}
        self.chars = {p for p in self.id if len(p) == 1}
        inner = {c for p in self.id if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces reach across spaces")
        feed = "" if "\n" in inner else "\n"
        self.units = re.compile(f"{SPACE}*[^{SPACE}{feed}]+|{SPACE}+" + (f"|{feed}" if feed else "")).findall
        # Pieces that their own text gives, each with its merge tree's edges: [(part, rank at which it is absorbed)], innermost first.
        self.left, self.right, plain = {}, {}, set()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if SPACE * 2 in p:
                continue
            tree = self._merge(p)
            if len(tree) != 1:
                continue
            node, edges, ordered = tree[0], {}, True
            for side in (0, 1):
                at, path, limit = node, [], math.inf
                while True:
                    path.append((self._text(at), limit))
                    if isinstance(at, str):
                        break
                    limit, at = self.rank[self._text(at)], at[side]
                edges[side] = path[::-1]
            stack = [node]
            while stack:
                at = stack.pop()
                if not isinstance(at, str):
                    ordered &= all(isinstance(x, str) or self.rank[self._text(x)] < self.rank[self._text(at)] for x in at)
                    stack += at
            if not ordered:
                plain.add(i)
            self.left[i], self.right[i] = edges[0], edges[1]
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.plain, self.pairs, self.known_pairs = plain, [{} for _ in self.pieces], 0
        self.sizes = [len(p) for p in self.pieces]
        # The next shorter piece that a piece starts with, -1 if there is none.
        self.shorter = [-1] * len(self.pieces)
        for i in self.left:
            p = self.pieces[i]
            self.shorter[i] = next((j for k in range(len(p) - 1, 0, -1) if (j := self.id.get(p[:k], -1)) in self.left), -1)
        self.names = [str(i) for i in range(len(self.pieces))]
        # What a piece alone decodes to; a byte of a longer character has no text of its own.
        self.texts = [None if self.byte_of.get(i, 0) > 127 else chr(self.byte_of[i]) if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        #: By unit its ids, joined by commas, and what they decode to.
        self.known = _Kept(self._unit)

    @staticmethod
    def _text(node) -> str:
        out, stack = [], [node]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                out.append(at)
            else:
                stack += (at[1], at[0])
        return "".join(out)

    def _merge(self, unit: str) -> list:
        """Plain merging of neighbours, best rank and then leftmost first; nodes are characters or pairs of nodes."""
        n = len(unit)
        node, text, after, before = list(unit), list(unit), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := self.rank.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if text[i] is None or len(text[i]) != a or j >= n or len(text[j]) != b:
                continue
            node[i], text[i], text[j] = (node[i], node[j]), text[i] + text[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.rank.get(text[i] + text[k])) is not None:
                    heapq.heappush(heap, (r, i, len(text[i]), len(text[k])))
            if (h := before[i]) >= 0 and (r := self.rank.get(text[h] + text[i])) is not None:
                heapq.heappush(heap, (r, h, len(text[h]), len(text[i])))
        return [x for x, t in zip(node, text, strict=True) if t is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether re-merging the texts of a and b gives a and b again."""
        if self.known_pairs >= KNOWN_PAIRS:
            self.known_pairs = 0
            for row in self.pairs:
                row.clear()
        self.known_pairs += 1
        known = self.pairs[a][b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        if a in self.plain or b in self.plain:
            return [self._text(x) for x in self._merge(self.pieces[a] + self.pieces[b])] == [self.pieces[a], self.pieces[b]]
        right, left, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, gone_x), (y, gone_y) = right[i], left[j]
            r = self.rank.get(x + y)
            if r is not None and r < gone_x and r <= gone_y:
                return False
            if gone_x == gone_y == math.inf:
                return True
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1

    def _backtrack(self, unit: str) -> list[int]:
        """Ids of a unit whose characters are all pieces and that holds no two space marks in a row."""
        sizes, shorter, rows, n = self.sizes, self.shorter, self.pairs, len(unit)
        longest = [0] * n
        for end, i in self.automaton.iter(unit):  # by end, so the longest from each place is set last
            longest[end + 1 - sizes[i]] = i
        i = longest[0]
        pos = sizes[i]
        if pos == n:
            return [i]
        out, failed, row = [i], 0, rows[i]  # failed: a bitfield of places
        i = longest[pos]
        while True:
            while i >= 0:
                end = pos + sizes[i]
                if not (failed and failed >> end & 1):
                    if row is None:
                        break
                    fits = row.get(i)
                    if fits is None:
                        fits = self.compatible(out[-1], i)
                    if fits:
                        break
                i = shorter[i]
            else:
                failed |= 1 << pos
                i = out.pop()
                pos -= sizes[i]
                row = rows[out[-1]] if out else None
                i = shorter[i]
                continue
            out.append(i)
            if end == n:
                return out
            row, pos, i = rows[i], end, longest[end]

    def _unit(self, unit: str) -> tuple[str, str]:
        """A unit's ids as text, and what they decode to."""
        ids = self.encode_unit(unit)
        parts = [self.texts[i] for i in ids]
        return ",".join([self.names[i] for i in ids]), self._join(ids) if None in parts else "".join(parts)

    def encode_unit(self, unit: str) -> list[int]:
        if SPACE * 2 in unit:
            out = []
            for x in self._merge(unit):
                t = self._text(x)
                out += [self.id[t]] if t in self.id else [self.bytes[b] for b in t.encode()]
            return out
        if self.chars.issuperset(unit):
            return self._backtrack(unit)
        out, start = [], 0
        for k, c in enumerate(unit):
            if c not in self.chars:
                out += self._backtrack(unit[start:k]) if k > start else []
                out += [self.bytes[b] for b in c.encode()]
                start = k + 1
        return out + (self._backtrack(unit[start:]) if start < len(unit) else [])

    def split(self, text: str) -> list[str]:
        return self.units((SPACE if self.prefix else "") + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [int(x) for u in self.split(text) for x in self.known[u][0].split(",")]

    def _join(self, ids: list[int]) -> str:
        out, raw = [], bytearray()

        def flush() -> None:
            while raw:  # bytes that are no character become U+FFFD one by one
                try:
                    out.append(raw.decode())
                    raw.clear()
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode() + "�")
                    del raw[: e.start + 1]

        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            flush()
            out.append("" if i in self.silent else " ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        first = next((k for k, i in enumerate(ids) if i not in self.silent), None)
        text = self._join(ids)
        return text[1:] if self.prefix and first is not None and self.pieces[ids[first]].startswith(SPACE) else text


_CODECS: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The worker's codec of a model, built once."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def read_model(path: str | None = None) -> bytes:
    """The model file, read on the driver; executors get its bytes (half a megabyte) with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def tokenise(documents: DataFrame, model: bytes, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids, decoded; with digests their SHA-256 in place of ids and decoded."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                counts, first, second = [], [], []
                for text in b.column(1):
                    units = c.split(text.as_py() or "")
                    got = list(map(c.known.__getitem__, units))
                    ids = ",".join([g for g, _ in got])
                    plain = "".join([g for _, g in got])
                    plain = plain[1:] if units and c.prefix else plain
                    counts.append(ids.count(",") + 1 if ids else 0)
                    first.append(sha(ids) if digests else array("i", map(int, ids.split(","))) if ids else array("i"))
                    second.append(sha(plain) if digests else plain)
                if not digests:
                    ends = np.cumsum([0, *counts]).astype(np.int32)
                    first = pa.ListArray.from_arrays(ends, np.concatenate([np.frombuffer(x, np.int32) for x in first]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), first if not digests else pa.array(first, pa.string()), pa.array(second, pa.string())], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, {names[2]} {'string' if digests else 'array<int>'}, {names[3]} string"
    return small_batches(documents).select("doc_id", "text").mapInArrow(released(run), schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(table(spark, sf_dir, "documents"), read_model(), digests=True)
