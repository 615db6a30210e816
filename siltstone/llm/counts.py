"""Token counts of a word-end BPE vocabulary by whole-token shortcut: it is proved beforehand which vocabulary strings encode alone as one token; pre-tokens among them count one without merging, and only the rest are merged.

The proof runs each vocabulary string that ends a word through normalisation, the split into pre-tokens and the merges themselves, once on the driver; the table it gives is as large as the vocabulary and goes to the executors with the task.

Edge cases: null and empty texts have no tokens; special strings inside a text count one each; repeated rows each give a row; no rows give no rows; further columns are ignored. Cached pre-tokens are bounded; long pre-tokens are merged by a heap."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import released, small_batches, table

END = "</w>"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CACHED, CACHED_CHARS = 150_000, 64
#: Bits of a symbol's number, and the rank of a pair that doesn't merge.
SHIFT, NONE = 20, 1 << 60
#: What str.split takes for white space and the vocabulary doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordCounter(dict):
    """Tokens by pre-token: the proved whole tokens, and what has been merged so far. `runs` are those of whole runs between white space."""

    def __init__(self, file: bytes, whole: dict[str, int] | None = None):
        import regex

        spec = json.loads(file)
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] != END:
            raise ValueError("only lower-casing word-end BPE files are supported")
        self.alphabet = byte_alphabet()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        # symbols by number, pairs of them as one number
        number: dict[str, int] = {}
        of = lambda symbol: number.setdefault(symbol, len(number))
        self.rank = {of(a) << SHIFT | of(b): i for i, (a, b) in enumerate(merges)}
        self.made = [of(a + b) for a, b in merges]
        self.first, self.last = ([of(self.alphabet[b] + end) for b in range(256)] for end in ("", END))
        special = [a["content"] for a in spec["added_tokens"]]
        self.special = regex.compile("|".join(sorted(map(regex.escape, special), key=len, reverse=True)))
        self.marks = [s[:2] for s in special]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", f"[^{WHITE}")
        self.words = regex.compile(pattern).findall
        self.plain = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall  # the same for lower-case ASCII
        self.split = re.compile(f"[^{WHITE}]+").findall
        self.runs = RunCounter(self)
        super().__init__(self.prove(spec["model"]["vocab"]) if whole is None else whole)
        self.proved = len(self)

    def prove(self, vocabulary: dict[str, int]) -> dict[str, int]:
        back = {c: b for b, c in self.alphabet.items()}
        out = {}
        for v in vocabulary:
            if v.endswith(END) and len(v) > len(END):
                try:
                    word = bytes(back[c] for c in v[: -len(END)]).decode()
                except (UnicodeDecodeError, KeyError):
                    continue
                if self.normal(word) == word and self.words(word) == [word] and self.merged(word) == 1:
                    out[word] = 1
        return out

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case letter by letter, so a capital sigma at a word's end is no exception. White space only separates, so runs of it need no replacement."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merged(self, word: str) -> int:
        """Symbols left when no merge applies: best rank, then leftmost first."""
        bytes_, get = word.encode(), self.rank.get
        s = [self.first[b] for b in bytes_[:-1]]
        s.append(self.last[bytes_[-1]])
        n = len(s)
        if n <= 64:
            # a merge changes the ranks of its two neighbours only
            ranks, made = [get(a << SHIFT | b, NONE) for a, b in zip(s, s[1:], strict=False)], self.made
            while ranks:
                r = min(ranks)
                if r == NONE:
                    break
                i = ranks.index(r)
                s[i] = m = made[r]
                del s[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = get(m << SHIFT | s[i + 1], NONE)
                if i:
                    ranks[i - 1] = get(s[i - 1] << SHIFT | m, NONE)
            return len(s)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := get(s[i] << SHIFT | s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or s[i] != a or s[j] != b:
                continue
            s[i], s[j] = self.made[rank], None
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(s[i] << SHIFT | s[k])) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[k]))
            if (h := before[i]) >= 0 and (r := get(s[h] << SHIFT | s[i])) is not None:
                heapq.heappush(heap, (r, h, s[h], s[i]))
        return left

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED + self.proved:  # the proved ones were put in first, and stay
                for w in [w for k, w in enumerate(self) if k >= self.proved]:
                    del self[w]
            self[word] = n
        return n

    def count(self, text: str) -> int:
        parts, n = [text], 0
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            n = len(parts) - 1
        return n + sum(sum(map(self.runs.__getitem__, p.split() if p.isascii() and not SEPARATORS.search(p) else self.split(p))) for p in parts)


class RunCounter(dict):
    """Tokens by run of characters between white space. No pre-token holds white space, nor do normalisation and lower case reach over it, so a text's tokens are those of its runs, and a run that was seen before is neither normalised nor split again."""

    def __init__(self, words: WordCounter):
        super().__init__()
        self.of = words

    def __missing__(self, run: str) -> int:
        if run.isascii():
            low = run.lower()
            n = self.of[low] if low.isalpha() else sum(map(self.of.__getitem__, self.of.plain(low)))
        else:
            n = sum(map(self.of.__getitem__, self.of.words(self.of.normal(run))))
        if len(run) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[run] = n
        return n


_COUNTERS: dict[bytes, WordCounter] = {}


def counter(file: bytes, whole: dict[str, int] | None = None) -> WordCounter:
    key = hashlib.sha256(file).digest()
    if key not in _COUNTERS:
        _COUNTERS[key] = WordCounter(file, whole)
    return _COUNTERS[key]


def read_vocabulary(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def count_tokens(documents: DataFrame, file: bytes, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    import pyarrow as pa

    mine = counter(file)
    whole = {w: n for k, (w, n) in enumerate(mine.items()) if k < mine.proved}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(file, whole)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return small_batches(documents).select("doc_id", "text").mapInArrow(released(run), f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary())
