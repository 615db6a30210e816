"""Encoding, decoding and counts against the libraries themselves."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siltstone.llm import counts, pieces

ODD = ["", " ", "  ", "a  b   c" + " " * 40 + "d", "\n\n a\tb\r\n", "▁x ▁▁", "naïve ﬁ ①", "\x00\x01 zz", "\U0001f642 é 日本語한국", "<s> </s> <unk> <0x41> <|endoftext|>x<|startoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "x" * 20000, "é ΣΣ İI I'LL we've '", "1234.5 ½² a1b2", "a　b c\x85d e\x1cf", "<|endoftext|><|endoftext|>", "ßẞ ǅ"]


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    rng = random.Random(5)
    own = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    letters = "abcdeftionhs ▁ .,'!0123\néß中\U0001f642AB<|>"
    noise = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    words = ["".join(rng.choice(["the", "th", "e", "in", "ing", "er", "ation", " ", "re", "on", "es", "  "]) for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    return ODD + own + noise + words


def test_pieces_equal_library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    c = pieces.codec(pieces.read_model())
    for t in texts:
        ids = sp.encode(t)
        assert c.encode(t) == ids, t[:100]
        assert c.decode(ids) == sp.decode(ids), t[:100]
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(1, 8))]
        assert c.decode(ids) == sp.decode(ids), ids


def test_compatibility_is_re_merging():
    c = pieces.codec(pieces.read_model())
    rng = random.Random(2)
    own = [i for i in c.right]
    for _ in range(20000):
        a, b = rng.choice(own), rng.choice(own)
        if c.pieces[b].startswith(pieces.SPACE):
            continue
        assert c._compatible(a, b) == ([c._text(x) for x in c._merge(c.pieces[a] + c.pieces[b])] == [c.pieces[a], c.pieces[b]]), (c.pieces[a], c.pieces[b])


def test_counts_equal_library(texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    c = counts.counter(counts.read_vocabulary())
    for x in texts:
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), x[:100]
    assert c.proved > 30000


def test_whole_tokens_encode_alone():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    c = counts.counter(counts.read_vocabulary())
    proved = [w for k, w in enumerate(c) if k < c.proved]
    assert all(len(e.ids) == 1 for e in t.encode_batch(proved, add_special_tokens=False))


def test_frames(spark):
    rows = [(i, x, 1) for i, x in enumerate([None, *ODD, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    full = {r["doc_id"]: r for r in pieces.tokenise(df, pieces.read_model()).collect()}
    for r in pieces.tokenise(df, pieces.read_model(), digests=True).collect():
        ids = sp.encode(rows[r["doc_id"]][1] or "")
        assert r["n_tokens"] == len(ids) and full[r["doc_id"]]["ids"] == ids and full[r["doc_id"]]["decoded"] == sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in counts.count_tokens(df, counts.read_vocabulary(), 100).collect():
        x = rows[r["doc_id"]][1] or ""
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(x.encode()), n, n > 100)
    empty = df.limit(0)
    assert pieces.tokenise(empty, pieces.read_model()).count() == counts.count_tokens(empty, counts.read_vocabulary()).count() == 0


def test_runs_between_white_space_are_counted_once(texts, monkeypatch):
    """A run that was seen before is looked up whole, also with marks that join letters and with separators that are no white space here."""
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    c = counts.WordCounter(counts.read_vocabulary())
    assert c.count("Some words, some WORDS and words.") == c.count("Some words, some WORDS and words.")
    monkeypatch.setattr(c, "words", None)  # nothing is split again
    assert c.count("words. Some words,\n and  WORDS\tand some") == len(t.encode("words. Some words,\n and  WORDS\tand some", add_special_tokens=False).ids)
    monkeypatch.undo()
    for x in ["e ́a é ́", "a\x1cb \x1d c\x1e", " a b c", "ᄀ ᅡ 가"]:
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)
