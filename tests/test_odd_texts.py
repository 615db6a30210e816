"""Catalogued queries against their SQL on texts that the given tables lack."""

import duckdb
import pytest

from siltstone.plans import catalog


@pytest.fixture
def odd(spark, sf, tmp_path):
    """A function that puts rows (text, lang, source) as the documents beside the given embeddings, and compares a query with its SQL."""

    def compare(name, rows):
        folder = str(tmp_path)
        named = [(k, *r) for k, r in enumerate(rows)]
        spark.createDataFrame(named, "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/embeddings.parquet").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        got = catalog.QUERIES[name](spark, folder)
        cols = ", ".join(f'"{c}"' for c in got.columns)
        want = con.sql(f"SELECT {cols} FROM ({catalog.ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
        return want

    return compare


def test_simple_scores(odd):
    """Null texts and names, spaces of Unicode at the ends, vertical tabs, generic phrases, lines within names."""
    texts = [None, "", " \n", "\x0b", "x" * 78 + "  ", "　" * 3 + "x" * 80, "a \x0b " * 15, "x " * 40 + "comprehensive guide to", "y " * 30 + "\x85", "b\x85" * 45, "q" * 199 + "\t\r\n", "hyde: " + "z" * 76]
    rows = [(t, "en", "src1") for t in texts] + [("k" * 100, None, "src1"), ("k" * 100, "en", None), ("k" * 100, "en\nlex: u", "a\nhyde: q")]
    assert len(odd("simple_scores", rows)) == len(rows)


def test_hit_rates(odd):
    """Every text asks, those of two words, of one and of none too."""
    words = "alpha beta gamma delta alphabet bet gam".split()
    texts = [" ".join(words[(k * j + k) % 7] for j in range(1, 3 + k % 5)) for k in range(30)] + ["alpha beta", "alpha", "Alpha", "", "- !", None, "été ß 7", "été"]
    got = odd("hit_rates", [(t, "en", f"src{k % 3}") for k, t in enumerate(texts)])
    assert {d: n for d, n, _ in got} == dict.fromkeys(("easy", "medium", "hard"), len(texts)) and all(h for *_, h in got)
