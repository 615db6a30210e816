"""Files with names: no two rows in one file, a second run changes nothing, and what is written reads back."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import knowledge
from siltstone.sources import named


def names_by_hand(drafts, taken):
    held, out = set(taken), {}
    for folder, stem, at in sorted(drafts, key=lambda d: d[2]):
        name = next(n for k in itertools.count(1) if (folder, n := f"{stem}-{k}.md" if k > 1 else f"{stem}.md") not in held)
        held.add((folder, name))
        out[at] = name
    return out


@pytest.mark.parametrize("seed", range(4))
def test_draft_names_are_those_of_one_after_the_other(spark, seed):
    rnd = random.Random(seed)
    stems = ["a", "a-2", "a-2-2", "a-3", "b", "a-1", "a-02"]
    drafts = [(rnd.choice("xy"), rnd.choice(stems), k) for k in range(40)]
    rnd.shuffle(drafts)
    taken = {("x", "a.md"), ("x", "a-4.md"), ("y", "a-2-2.md"), ("y", "b-2.md"), ("x", "a-1.md"), ("y", "a-02.md")} if seed else set()
    got = knowledge.draft_names(spark.createDataFrame(drafts, "folder string, stem string, created int"), spark.createDataFrame(list(taken), "folder string, file_name string"))
    assert {r["created"]: r["file_name"] for r in got.collect()} == names_by_hand(drafts, taken)


def files(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, ns in os.walk(root) for n in ns if not n.startswith(".")}


def test_write_and_write_again(spark, tmp_path):
    root = str(tmp_path / "vault")
    rows = spark.createDataFrame([("a/b c.md", "one\ntwo\n\n"), ("a/é%=[x].md", "drei"), ("c.md", "")], "target string, text string")
    assert named.write(rows, root) == 3
    assert files(root) == {"a/b c.md": "one\ntwo\n", "a/é%=[x].md": "drei\n", "c.md": "\n"}
    assert {r["target"]: r["text"] for r in named.files_under(spark, root).collect()} == files(root)
    stamps = {n: os.stat(f"{root}/{n}").st_mtime_ns for n in files(root)}
    assert named.write(rows, root) == 0 and {n: os.stat(f"{root}/{n}").st_mtime_ns for n in files(root)} == stamps
    assert named.write(rows.withColumn("text", F.when(F.col("target") == "c.md", "new").otherwise(F.col("text"))), root) == 1
    assert files(root)["c.md"] == "new\n" and len(files(root)) == 3
    with pytest.raises(ValueError):
        named.write(rows.unionByName(rows), root)


def test_cards_syntheses_and_drafts(spark, tmp_path):
    root = str(tmp_path / "vault")
    card = spark.createDataFrame([("t", "0123456789ab", "https://h/x", 'A "title": b', None, "2026-01-02", "2026-01-03", "en", ["x", "y: z"], "ff", ["short"], ["a\nb", "c"]), ("t", "1123456789ab", "https://h/y", "Plain", "Who", None, "2026-01-03", "en", [], "ee", ["s", "t"], [])], "topic_id string, source_id string, url string, title string, author string, published string, fetched string, language string, tags array<string>, body_hash string, tldr array<string>, excerpts array<string>")
    assert named.write(named.cards(card), root) == 2 and named.write(named.cards(card), root) == 0
    text = files(root)["research/notes/t/sources/0123456789ab.md"]
    assert text.startswith('---\ntype: research-card\ntopic: t\nsource_id: "0123456789ab"\nurl: "https://h/x"\ntitle: "A \\"title\\": b"\nauthor: null\n')
    assert 'tags:\n  - x\n  - "y: z"\nbody_hash: ff\n' in text and "> a b\n\n> c\n" in text and "- short\n" in text and text.endswith("(https://h/x)\n")
    other = files(root)["research/notes/t/sources/1123456789ab.md"]
    assert "tags: []" in other and "_(none)_" in other
    held = named.files_under(spark, root).select(named.card_front(F.col("text")).alias("h")).collect()
    assert {r["h"] for r in held} == {"ff", "ee"}
    note = spark.createDataFrame([("t", "parts", "2026", "m", ["0123456789ab"], "Body")], "topic_id string, subtopic string, generated_at string, model string, source_cards array<string>, body_md string")
    assert named.write(named.syntheses(note), root) == 1 and files(root)["research/notes/t/parts.md"].endswith("\n---\n\nBody\n")
    schema = "topic_id string, slug string, day string, prompt string, generated_at string, model string, context_sources array<string>, include_vault boolean, body_md string"
    rows = [("t", "s", "2026-01-01", "p", f"g{k}", "m", [], False, f"draft {k}") for k in range(3)]
    first = spark.createDataFrame(rows, schema)
    assert named.write(named.drafts(first, root), root) == 3
    have = [n for n in files(root) if "drafts" in n]
    assert sorted(have) == [f"research/drafts/t/2026-01-01-s{x}.md" for x in ("-2", "-3", "")]
    assert named.write(named.drafts(first, root), root) == 0  # a re-run names nothing anew
    more = spark.createDataFrame([*rows, ("t", "s", "2026-01-01", "p", "g9", "m", [], False, "draft 9")], schema)
    assert named.write(named.drafts(more, root), root) == 1 and "research/drafts/t/2026-01-01-s-4.md" in files(root)


def test_knowledge_notes_merge(spark, tmp_path):
    root = str(tmp_path / "vault")
    schema = "folder string, file_name string, title string, project string, tags array<string>, summary string, source string, insights array<struct<date: string, session: string, content: string>>"
    a = ("p", "n.md", "N", "p", ["x", "y"], "Sum", "s1", [("2026-01-01", "s1", "first")])
    b = ("p", "n.md", "N", "p", ["x"], "Other", "s2", [("2026-01-02", "s2", "second")])
    one = spark.createDataFrame([a], schema)
    assert named.write(named.knowledge(one, root, "2026-02-01"), root) == 1
    assert files(root)["knowledge/p/n.md"].startswith("---\ntitle: N\nproject: p\ntags: [x, y]\ncreated: 2026-02-01\nupdated: 2026-02-01\nsources:\n  - s1\n---\n")
    both = spark.createDataFrame([a, b], schema)
    assert named.write(named.knowledge(both, root, "2026-02-02"), root) == 1
    text = files(root)["knowledge/p/n.md"]
    assert "created: 2026-02-01\nupdated: 2026-02-02\nsources:\n  - s1\n  - s2\n---\n" in text and text.count("first") == 1 and text.endswith("second\n") and "Other" not in text
    assert named.write(named.knowledge(both, root, "2026-02-03"), root) == 0
    whole = str(tmp_path / "whole")
    assert named.write(named.knowledge(both, whole, "2026-02-02"), whole) == 1
    assert files(whole)["knowledge/p/n.md"].replace("created: 2026-02-02", "created: 2026-02-01") == text
