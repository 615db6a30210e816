"""Conversation repair against a plain dynamic programme, and the algebra of its matrices."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from siltstone.llm import turns

WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, kind string, node int"


def damaged(rows):
    out = defaultdict(list)
    for c, t, r, x, *_ in rows:
        r, x = [" " if v is None else v for v in (r, x)]
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        out[c] += [(t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def after(state, role):
    return {"0s": "s", "0u": "u", "su": "u", "ua": "a", "au": "u"}.get(state + role)


def inserted(best):
    """States reached by insertions from those in best: cost, audit, lines."""
    todo = list(best)
    while todo:
        state = todo.pop()
        for role in ("user", "assistant"):
            n = after(state, role[0])
            cost, audit, lines = best[state]
            if n and (n not in best or (cost + 2, audit + "I") < best[n][:2]):
                best[n] = cost + 2, audit + "I", [*lines, f"{role}:"]
                todo.append(n)
    return best


def brute(conversations):
    out = []
    for c, rows in conversations.items():
        rows = sorted(rows, key=lambda a: (a[0] is not None, a[0] or 0, a[1], hashlib.sha256(a[2].encode()).digest()))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        seen, faults, best = set(), [], inserted({"0": (0, "", [])})
        for _, role, text in rows:
            said = WORD.findall(text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
            options = []
            for state, (cost, audit, lines) in best.items():
                options.append((state, (cost + 3, audit + "D", lines)))
                if faults[-1] not in ("blank", "duplicate"):
                    more = int(faults[-1] == "truncated")
                    options.append((after(state, role[:1]), (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
                    options += [(after(state, r[0]), (cost + 2 + more, audit + "R", [*lines, f"{r}:{text}"])) for r in ("user", "assistant")]
            best = {}
            for state, option in options:
                if state and (state not in best or option[:2] < best[state][:2]):
                    best[state] = option
            best = inserted(best)
        cost, audit, lines = min((best[s] for s in "0a" if s in best), key=lambda v: v[:2])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows(n=600):
    rnd = random.Random(11)
    rows = []
    for _ in range(n):
        text = rnd.choice(["", " \t\n", None, "no end", "An end.", "Is it?  ", "\u00a0", "\U0001f600!", "a" * 3000 + ".", "An end."])
        rows.append((rnd.choice([None, 1, 2, 3, 4, 5, *range(6, 60)]), rnd.choice([None, *range(30)]), rnd.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool", "User"]), text, "x", 0))
    rows += [(900, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool"]), f"turn {t}" + rnd.choice(["", ".", "."]), "x", 0) for t in range(300)]
    rows += [(901, 5, "user", "The same.", "x", 0)] * 200  # repeated rows
    rows += [(902, t, "user", "The same.", "x", 0) for t in range(100)]
    return rows


def report(spark, rows, **how):
    out, lines = turns.repair(spark.createDataFrame(rows, SCHEMA), **how)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in out.select(*columns).collect()), key=repr), lines


def undamaged(rows):
    out = defaultdict(list)
    for c, t, r, x, *_ in rows:
        out[c].append((t, *(" " if v is None else v for v in (r, x))))
    return out


def test_odd_rows(spark):
    rows = odd_rows()
    assert report(spark, rows)[0] == brute(undamaged(rows))


def test_many_small_stretches_and_levels(spark):
    """Stretches of three turns, pairs on each level: the way up and down is many steps, the answer the same."""
    rows = odd_rows(150)
    got, lines = report(spark, rows, segment=3, fan=2)
    assert got == brute(undamaged(rows))
    by = defaultdict(list)
    for r in lines.orderBy("node", "at", "part").collect():
        by[r["conv_id"]].append(r["role"][:1])
    assert all(re.fullmatch("s?(ua)+", "".join(v)) for v in by.values())


def test_damage_and_query(spark, sf, tmp_path):
    import duckdb

    rows = odd_rows()
    got = defaultdict(list)
    for r in turns.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    assert {c: sorted(v, key=repr) for c, v in got.items()} == {c: sorted(v, key=repr) for c, v in damaged(rows).items() if v}
    given = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    every = {c: damaged(given).get(c, []) for c in {r[0] for r in given}}
    assert sorted((tuple(r) for r in turns.op13_structure_repair(spark, sf).collect()), key=repr) == brute(every)


def test_nothing_left_and_no_rows(spark, tmp_path):
    out, lines = turns.repair(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and lines.collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hello.", "x", 0)], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = turns.op13_structure_repair(spark, str(tmp_path)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_the_product_is_associative():
    kinds = ["s", "u", "a", "x", "d", "S", "U", "A", "X"]
    for a, b, c in itertools.product(kinds, repeat=3):
        x, y, z = (turns.turn_matrix(k) for k in (a, b, c))
        assert turns.times(turns.times(x, y), z) == turns.times(x, turns.times(y, z))
