"""Cutting documents at structural break points."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from siltstone.batches import BATCH_BYTES, released, small_batches
from siltstone.functions import code

#: Characters of a chunk, of its overlap with the next, and of the window before the target in which a break is looked for; characters a token at first guess. Fixed values.
SIZE, OVERLAP, WINDOW, TOKENS, CHARS_PER_TOKEN = 3600, 540, 800, 900, 3
#: Break patterns with their scores; a break is at the match's start, and the best score of a place counts. Fixed values.
BREAKS = [
    (r"\n#{1}(?!#)", 100),
    (r"\n#{2}(?!#)", 90),
    (r"\n#{3}(?!#)", 80),
    (r"\n#{4}(?!#)", 70),
    (r"\n#{5}(?!#)", 60),
    (r"\n#{6}(?!#)", 50),
    (r"\n```", 80),
    (r"\n(?:---|\*\*\*|___)\s*\n", 60),
    (r"\n\n+", 20),
    (r"\n[-*]\s", 5),
    (r"\n\d+\.\s", 5),
    (r"\n", 1),
]
_BREAKS = [(re.compile(p), s) for p, s in BREAKS]


def break_points(text: str) -> dict[int, int]:
    out: dict[int, int] = {}
    for pattern, score in _BREAKS:
        for m in pattern.finditer(text):
            out[m.start()] = max(score, out.get(m.start(), 0))
    return out


def fences(text: str) -> list[tuple[int, int]]:
    """Spans between code fences; one that isn't closed runs to the end."""
    marks = [m.start() for m in re.finditer(r"\n```", text)]
    spans = [(a, b + 4) for a, b in zip(marks[::2], marks[1::2], strict=False)]
    return spans + [(marks[-1], len(text))] if len(marks) % 2 else spans


def cutoff(points: list[int], scores: dict[int, int], spans: list[tuple[int, int]], target: int) -> int:
    """The break before target with the best score, which fades with the square of its distance; target if there is none."""
    best, where = -1.0, target
    for p in points[bisect_left(points, target - WINDOW) : bisect_right(points, target)]:
        if any(a < p < b for a, b in spans):
            continue
        s = scores[p] * (1 - 0.7 * ((target - p) / WINDOW) ** 2)
        if s > best:
            best, where = s, p
    return where


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP, extra: dict[int, int] | None = None) -> list[tuple[int, str]]:
    """(pos, text) of a document's chunks."""
    if len(text) <= size:
        return [(0, text)]
    scores = break_points(text)
    for p, s in (extra or {}).items():
        scores[p] = max(s, scores.get(p, 0))
    points, spans, out, pos = sorted(scores), fences(text), [], 0
    while pos < len(text):
        end = target = min(pos + size, len(text))
        if target < len(text):
            at = cutoff(points, scores, spans, target)
            end = at if at > pos else target
        out.append((pos, text[pos:end]))
        if end >= len(text):
            break
        back = end - overlap
        pos = back if back > out[-1][0] else end
    return out


def chunks_by_tokens(text: str, count: Callable[[str], int], most: int = TOKENS, extra: dict[int, int] | None = None) -> list[tuple[int, str]]:
    """Chunks of at most `most` tokens by an injected counter: cut by characters first, and pieces that are still too long are cut again, in halves at last."""
    out, todo = [], [(p, t, SIZE * 3 // 4) for p, t in chunks(text, most * CHARS_PER_TOKEN, most * CHARS_PER_TOKEN * 15 // 100, extra)]
    while todo:
        pos, piece, _ = todo.pop(0)
        n = count(piece)
        if n <= most or len(piece) < 2:
            out.append((pos, piece))
            continue
        size = max(1, int(len(piece) * most / n * 0.95))
        parts = chunks(piece, size, 0)
        if len(parts) < 2:
            half = len(piece) // 2
            parts = [(0, piece[:half]), (half, piece[half:])]
        todo = [(pos + p, t, size) for p, t in parts] + todo
    return out


def chunk_documents(documents: DataFrame, key: str = "hash", text: str = "doc", path: str | None = None, size: int = SIZE, overlap: int = OVERLAP, count: Callable[[str], int] | None = None) -> DataFrame:
    """(key, seq, pos, text) of every document's chunks; with a path column code is also cut at its constructs, with a counter chunks are bounded in tokens. A task holds a small batch of texts, and of their chunks BATCH_BYTES and those of one text."""
    import pyarrow as pa

    cols = [key, text, *([path] if path else [])]
    kind = documents.schema[key].dataType.simpleString()

    def batch(rows: dict[str, list], kind_: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows["k"], kind_), pa.array(rows["seq"], pa.int32()), pa.array(rows["pos"], pa.int32()), pa.array(rows["text"], pa.string())], [key, "seq", "pos", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {"k": [], "seq": [], "pos": [], "text": []}
            held = 0
            for r in range(b.num_rows):
                body, p = b.column(1)[r].as_py() or "", b.column(2)[r].as_py() if path else ""
                extra = code.breaks(body, p or "")
                for seq, (pos, piece) in enumerate(chunks_by_tokens(body, count, extra=extra) if count else chunks(body, size, overlap, extra)):
                    for name, value in zip(rows, (b.column(0)[r].as_py(), seq, pos, piece), strict=True):
                        rows[name].append(value)
                held += 4 * len(body)  # as many bytes at most
                if held >= BATCH_BYTES:
                    yield batch(rows, b.schema.field(0).type)
                    rows, held = {name: [] for name in rows}, 0
            if rows["k"]:
                yield batch(rows, b.schema.field(0).type)

    return small_batches(documents).select(*cols).mapInArrow(released(run), f"{key} {kind}, seq int, pos int, text string")
