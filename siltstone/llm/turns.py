"""Conversation structure repair: the cheapest edits that give a conversation's turns the roles `(s?(ua)+)?`, by a min-plus scan of matrices.

Each turn is a 4x4 matrix over the states of that pattern (nothing yet, after s, after u, after a): the closure of insertions before it times its own edits. Elements are (cost, audit), audit being the edits' initials; the lesser cost wins, then the audit that is least in ASCII. Of two audits of equal cost for the same turns and states neither begins the other (what one had over would be insertions, which cost), so the order survives concatenation and the product is associative. Turns are dealt in order to partitions, each stretch of at most SEGMENT turns of a conversation in a partition becomes one matrix, and up to FAN neighbours become one until each conversation has one: a conversation of any length is spread over partitions, and no task holds more than FAN audits. The way back down gives every stretch the states in which the cheapest repair enters and leaves it, and so every turn its edit.

Edits: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (a user or assistant turn with empty text) 2; blank and duplicate turns must be deleted; a truncated turn that isn't deleted costs 1.

Edge cases: a null role or text is one space, so a null text is blank; turns are in the order of turn (nulls first), then role, then the SHA-256 of the text, where the input says no more; repeated rows stay, and all but the first are duplicates; a null conv_id is a conversation of its own; empty texts are blank; very long texts are read whole, twice, and stay out of the scan, which sees what they say of a turn; no rows give no rows; further columns are ignored."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import let, materialise, released, table

#: Turns of a stretch, and neighbours that become one matrix, at most.
SEGMENT, FAN = 256, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Roles of the states: after a turn of this role a conversation is in this state.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow a state, and the state then. Only a kept turn can be a system's.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)
#: A turn's kind, one character a turn: its role's initial (s, u, a or other: x), in capitals if truncated; d: must be deleted.
WORD = r"[^\x20\x09-\x0D]"

#: (cost, audit) by 4 * state before + state after; None where nothing leads there.
Matrix = tuple


def _least(options: list) -> tuple | None:
    return min((x for x in options if x is not None), default=None)


@functools.lru_cache(maxsize=None)
def closure() -> Matrix:
    """Insertions: none, or as many as lead from state to state most cheaply."""
    out = [(0, "") if i == j else None for i in range(4) for j in range(4)]
    for _ in range(4):
        for (i, role), j in NEXT.items():
            if role != "s":
                for a in range(4):
                    if out[4 * a + i] is not None:
                        cost, audit = out[4 * a + i]
                        out[4 * a + j] = _least([out[4 * a + j], (cost + INSERT, audit + "I")])
    return tuple(out)


def times(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in (0, 4, 8, 12):
        row = [(k, a[i + k]) for k in range(4) if a[i + k] is not None]
        for j in range(4):
            low, ways = None, []
            for k, x in row:
                y = b[4 * k + j]
                if y is not None:
                    cost = x[0] + y[0]
                    if low is None or cost < low:
                        low, ways = cost, [(x, y)]
                    elif cost == low:
                        ways.append((x, y))
            out.append(None if low is None else (low, min(x[1] + y[1] for x, y in ways)))
    return tuple(out)


@functools.lru_cache(maxsize=None)
def turn_matrix(kind: str) -> Matrix:
    out: list = [None] * 16
    extra, role = TRUNCATED * kind.isupper(), kind.lower()
    for i in range(4):
        out[5 * i] = (DELETE, "D")
    if role != "d":
        for (i, r), j in NEXT.items():
            ways = [out[4 * i + j]]
            if r == role:
                ways.append((KEEP + extra, "K"))
            if r != "s":
                ways.append((REROLE + extra, "R"))
            out[4 * i + j] = _least(ways)
    return times(closure(), tuple(out))


@functools.lru_cache(maxsize=1 << 14)
def stretch_matrix(kinds: str) -> Matrix:
    """Matrix of some turns by halving; short strings of kinds come again and again, so they are kept."""
    if len(kinds) == 1:
        return turn_matrix(kinds)
    half = len(kinds) // 2
    return times(stretch_matrix(kinds[:half]), stretch_matrix(kinds[half:]))


def whole(kinds: str) -> Matrix:
    """Matrix of a stretch, by pieces short enough to be worth keeping, then by halving."""
    done = [stretch_matrix(kinds[i : i + 8]) for i in range(0, len(kinds), 8)]
    return folded(done)


def folded(done: list[Matrix]) -> Matrix:
    while len(done) > 1:
        done = [times(*done[i : i + 2]) if i + 1 < len(done) else done[i] for i in range(0, len(done), 2)]
    return done[0]


def finish(m: Matrix) -> tuple[int, str, int]:
    """(cost, audit, state after the last turn) of the cheapest whole repair."""
    ways = []
    for j in range(4):
        for end in ACCEPTING:
            tail = closure()[4 * j + end]
            if m[j] is not None and tail is not None:
                ways.append((m[j][0] + tail[0], m[j][1] + tail[1], j))
    return min(ways)


def states(parts: list[Matrix], enter: int, leave: int) -> list[int]:
    """The states before each part and after the last, on the cheapest way from enter to leave."""
    best: dict = {enter: (0, "", (enter,))}
    for m in parts:
        new: dict = {}
        for i, (cost, audit, way) in best.items():
            for j in range(4):
                if (x := m[4 * i + j]) is not None:
                    option = (cost + x[0], audit + x[1], (*way, j))
                    if j not in new or option < new[j]:
                        new[j] = option
        best = new
    return list(best[leave][2])


def edits(kinds: str, audit: str, state: int) -> list[tuple[list[str], str, str | None]]:
    """For each turn the roles inserted before it, its edit, and its new role where it has one; then one entry ('I') more for what is inserted after the last, if anything is."""
    names, out, before, at = {USER: "user", ASSISTANT: "assistant"}, [], [], 0

    def produced() -> int:
        return ASSISTANT if state == USER else USER

    for e in audit:
        if e == "I":
            state = produced()
            before.append(names[state])
            continue
        kind, role = kinds[at].lower(), None
        at += 1
        if e == "R":
            state = produced()
            role = names[state]
        elif e == "K":
            state = NEXT[state, kind]
        out.append((before, e, role))
        before = []
    if before:
        out.append((before, "I", None))
    return out


MATRIX = "cost array<long>, audit array<string>"


def _pack(m: Matrix) -> tuple[list, list]:
    return [x and x[0] for x in m], [x and x[1] for x in m]


def _unpack(x: dict) -> Matrix:
    return tuple(None if c is None else (c, a) for c, a in zip(x["cost"], x["audit"]))


def _rows(run):
    """A function over rows as dicts, as one over Arrow batches; small batches go back, since audits may be long."""

    def over(schema: pa.Schema):
        @released
        def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in given:
                for lo in range(0, b.num_rows, 256):
                    out = [y for x in b.slice(lo, 256).to_pylist() for y in run(x)]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

        return batches

    return over


_KEY = pa.field("node", pa.int64())
_MATRIX = [pa.field("cost", pa.list_(pa.int64())), pa.field("audit", pa.list_(pa.string()))]


def _conv_type(df: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    t = df.schema["conv_id"].dataType
    return t.simpleString(), to_arrow_type(t)


def _given(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, sha of the text, and key, which only identical rows share and which is never null."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    return named.withColumns({"key": F.unhex(F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "sha")), 256)), "sha": F.unhex("sha")})


def fault_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, sha, key, copy, fault (blank, duplicate, truncated or null): every row of rows (conv_id, turn, role, text), each with its first fault. Texts stay behind: what they say of a turn goes on.

    Repeated rows are one row with a count while earlier rows are looked up: the least turn of each (conv_id, role, text) joins back on a key that is unique on both sides, so a text that fills a conversation is no hot key."""
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    given = _given(rows).select("conv_id", "turn", "role", "sha", "key", (~F.col("text").rlike(WORD)).alias("blank"), last.rlike("[.!?]").alias("ended"))
    one = [F.first(c).alias(c) for c in ("key", "blank", "ended")]
    distinct = materialise(given.groupBy("conv_id", "turn", "role", "sha").agg(F.count("*").alias("n"), *one), "turns-distinct")
    first = distinct.groupBy("conv_id", "role", "sha").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("f"))
    first = first.select(F.col("conv_id").alias("c"), F.col("f.turn").alias("t"), F.col("role").alias("r"), F.col("sha").alias("s"), F.lit(True).alias("leads"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s"))
    told = distinct.join(first, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    fault = F.when(F.col("blank"), "blank").when(F.col("leads").isNull() | (F.col("copy") > 1), "duplicate").when(~F.col("ended"), "truncated")
    return told.select("conv_id", "turn", "role", "sha", "key", "copy", fault.alias("fault"))


def _initial() -> Column:
    return F.substring("role", 1, 1)


def scan(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Of rows (conv_id, turn, role, text): the turns with fault, kind, place and the node of their stretch; the stretches with their matrices; the levels of the reduction."""
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "d").otherwise(
        let(F.when(_initial().isin("s", "u", "a"), _initial()).otherwise("x"), lambda r: F.when(F.col("fault") == "truncated", F.upper(r)).otherwise(r))
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "sha", "copy"]
    dealt = fault_rows(rows).withColumn("kind", kind).repartitionByRange(*order).withColumn("block", F.spark_partition_id())
    dealt = materialise(dealt, "turns-dealt")
    place = F.row_number().over(Window.partitionBy("block", "conv_id").orderBy(*order[1:])) - 1
    placed = materialise(dealt.withColumn("place", place).withColumn("stretch", F.floor(F.col("place") / segment)), "turns-placed")
    # Stretches are numbered over all blocks, in order; the driver sees one number a block.
    of = placed.groupBy("block").agg(F.max("stretch").alias("n")).orderBy("block").collect()
    at, base = 0, []
    for r in of:
        base.append((r["block"], at))
        at += r["n"] + 1
    based = F.broadcast(rows.sparkSession.createDataFrame(base or [(0, 0)], "block int, base long"))
    numbered = placed.join(based, "block").withColumn("node", F.col("base") + F.col("stretch"))
    kinds = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), "")
    ends = [F.min_by(_initial(), "place").alias("first"), F.max_by(_initial(), "place").alias("last")]
    grouped = numbered.groupBy("conv_id", "node").agg(kinds.alias("kinds"), *ends)
    name, kind_of = _conv_type(rows)

    def one(x: dict) -> list[dict]:
        cost, audit = _pack(whole(x["kinds"]))
        return [{**x, "cost": cost, "audit": audit}]

    schema = pa.schema([pa.field("conv_id", kind_of), _KEY, *[pa.field(c, pa.string()) for c in ("kinds", "first", "last")], *_MATRIX])
    segments = materialise(grouped.mapInArrow(_rows(one)(schema), f"conv_id {name}, node long, kinds string, first string, last string, {MATRIX}"), "turns-stretches")
    return numbered, segments, _tree(segments, fan, name, kind_of)


def _tree(segments: DataFrame, fan: int, name: str, kind_of: pa.DataType) -> list[DataFrame]:
    """Levels of the reduction: conv_id, node, parts (node, cost, audit by node), cost, audit. The last has one row a conversation."""
    schema = pa.schema([pa.field("conv_id", kind_of), _KEY, pa.field("parts", pa.list_(pa.struct([_KEY, *_MATRIX]))), *_MATRIX])

    def join(x: dict) -> list[dict]:
        cost, audit = _pack(folded([_unpack(p) for p in x["parts"]]))
        return [{**x, "cost": cost, "audit": audit}]

    levels, at = [], segments
    while True:
        up = at.groupBy("conv_id", F.floor(F.col("node") / fan).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "cost", "audit"))).alias("parts"))
        at = materialise(up.mapInArrow(_rows(join)(schema), f"conv_id {name}, node long, parts array<struct<node: long, cost: array<long>, audit: array<string>>>, {MATRIX}"), "turns-level")
        levels.append(at)
        if not at.groupBy("conv_id").count().filter("count > 1").limit(1).count():
            return levels


def totals(levels: list[DataFrame]) -> DataFrame:
    """conv_id, node, total_cost, total_audit, leave: the cheapest repair of each conversation, and the state after its last turn."""
    name, kind_of = _conv_type(levels[-1])

    def end(x: dict) -> list[dict]:
        cost, audit, leave = finish(_unpack(x))
        return [{"conv_id": x["conv_id"], "node": x["node"], "total_cost": cost, "total_audit": audit, "leave": leave}]

    schema = pa.schema([pa.field("conv_id", kind_of), _KEY, pa.field("total_cost", pa.int64()), pa.field("total_audit", pa.string()), pa.field("leave", pa.int32())])
    return levels[-1].select("conv_id", "node", "cost", "audit").mapInArrow(_rows(end)(schema), f"conv_id {name}, node long, total_cost long, total_audit string, leave int")


def edit_rows(numbered: DataFrame, segments: DataFrame, levels: list[DataFrame], ends: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, node, at (its place in its stretch), turn, role, key, edit, inserted (roles), new_role of every turn, and one row without a turn where something is inserted after a conversation's last turn."""
    name, kind_of = _conv_type(segments)
    went = ends.select("conv_id", "node", F.lit(START).alias("enter"), "leave", F.lit(True).alias("final"))
    fields = [pa.field("conv_id", kind_of), _KEY, pa.field("enter", pa.int32()), pa.field("leave", pa.int32()), pa.field("final", pa.bool_())]

    def down(x: dict) -> list[dict]:
        way = states([_unpack(p) for p in x["parts"]], x["enter"], x["leave"])
        last = len(x["parts"]) - 1
        return [{"conv_id": x["conv_id"], "node": p["node"], "enter": way[i], "leave": way[i + 1], "final": x["final"] and i == last} for i, p in enumerate(x["parts"])]

    def on(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.withColumnRenamed("conv_id", "_c").withColumnRenamed("node", "_n")
        return left.join(named, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n"))).drop("_c", "_n")

    for level in reversed(levels):
        went = on(level.select("conv_id", "node", "parts"), went).mapInArrow(_rows(down)(pa.schema(fields)), f"conv_id {name}, node long, enter int, leave int, final boolean")
        went = materialise(went, "turns-states")

    def apart(x: dict) -> list[dict]:
        audit = x["audit"][4 * x["enter"] + x["leave"]]
        if x["final"]:
            audit += min(t for t in (closure()[4 * x["leave"] + e] for e in ACCEPTING) if t is not None)[1]
        found = edits(x["kinds"], audit, x["enter"])
        return [{"conv_id": x["conv_id"], "node": x["node"], "at": i, "edit": e, "inserted": i_roles, "new_role": role} for i, (i_roles, e, role) in enumerate(found)]

    given = [pa.field("conv_id", kind_of), _KEY, pa.field("at", pa.int64()), pa.field("edit", pa.string()), pa.field("inserted", pa.list_(pa.string())), pa.field("new_role", pa.string())]
    every = on(segments.select("conv_id", "node", "kinds", "audit"), went).mapInArrow(_rows(apart)(pa.schema(given)), f"conv_id {name}, node long, at long, edit string, inserted array<string>, new_role string")
    mine = numbered.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), (F.col("place") - F.col("stretch") * segment).alias("_at"), "turn", "role", "key")
    joined = every.join(mine, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")) & (F.col("at") == F.col("_at")), "left")
    return joined.drop("_c", "_n", "_at")


def repaired_rows(edited: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, node, at, part, role, text: the repaired turns, in the order of (node, at, part). Of the texts of rows each that stays meets its turn once; a turn that stays is no duplicate, so the keys are unique."""
    new = F.transform("inserted", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    stays = F.col("edit").isin("K", "R")
    texts = _given(rows).groupBy("key").agg(F.first("text").alias("text"))
    own = F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))
    parts = [edited.filter(stays).join(texts, "key").withColumn("lines", F.concat(new, own)), edited.filter(~stays).withColumn("lines", new)]
    out = [p.select("conv_id", "node", "at", F.posexplode("lines").alias("part", "t")).select("conv_id", "node", "at", "part", "t.role", "t.text") for p in parts]
    return out[0].unionByName(out[1])


def digests(lines: DataFrame, name: str, kind_of: pa.DataType) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` lines joined by newlines.

    SHA-256 goes through a conversation byte by byte, so its lines pass through one task, sorted outside of memory and hashed as they come; nothing is held."""
    schema = pa.schema([pa.field("conv_id", kind_of), pa.field("repaired_sha256", pa.string())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, out, begun = None, None, [], False
        for b in batches:
            for conv, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist()):
                if begun and conv == at:
                    h.update(b"\n" + line.encode())
                else:
                    if begun:
                        out.append({"conv_id": at, "repaired_sha256": h.hexdigest()})
                    at, h, begun = conv, hashlib.sha256(line.encode()), True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if begun:
            out.append({"conv_id": at, "repaired_sha256": h.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    line = F.concat("role", F.lit(":"), "text").alias("line")
    dealt = lines.select("conv_id", "node", "at", "part", line).repartition("conv_id").sortWithinPartitions("conv_id", "node", "at", "part")
    return dealt.select("conv_id", "line").mapInArrow(run, f"conv_id {name}, repaired_sha256 string")


def illegal_pairs(numbered: DataFrame, segments: DataFrame, legal: tuple[str, ...] = ("su", "ua", "au")) -> DataFrame:
    """conv_id, illegal: neighbours whose roles' initials are none of `legal`; within stretches by their turns, between them by the ends."""
    inside = Window.partitionBy("conv_id", "node").orderBy("place")
    pair = F.concat(F.lag(_initial()).over(inside), _initial())
    within = numbered.select("conv_id", "node", pair.alias("pair")).filter("pair is not null").select("conv_id", "pair")
    # A conversation's stretches are its turns by the hundreds; they are sorted by range, not by conversation, so a long one has many tasks.
    ends = segments.select("conv_id", "node", "first", "last")
    dealt = materialise(ends.repartitionByRange(F.asc_nulls_first("conv_id"), "node").withColumn("b", F.spark_partition_id()), "turns-ends")
    before = F.lag("last").over(Window.partitionBy("b", "conv_id").orderBy("node"))
    run = dealt.select("conv_id", F.concat(before, "first").alias("pair")).filter("pair is not null")
    edge = dealt.groupBy("conv_id", "b").agg(F.min_by("first", "node").alias("first"), F.max_by("last", "node").alias("last"))  # a row a task and conversation
    over = F.lag("last").over(Window.partitionBy("conv_id").orderBy("b"))
    between = edge.select("conv_id", F.concat(over, "first").alias("pair")).filter("pair is not null")
    bad = within.unionByName(run).unionByName(between)
    return bad.groupBy("conv_id").agg(F.sum((~F.col("pair").isin(*legal)).cast("long")).alias("illegal"))


def repair(conversations: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Of conversations (conv_id, turn, role, text): a report, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; and the repaired turns, conv_id, node, at, part, role, text, in the order of (node, at, part)."""
    numbered, segments, levels = scan(conversations, segment, fan)
    name, kind_of = _conv_type(conversations)
    ends = materialise(totals(levels), "turns-totals")
    edited = materialise(edit_rows(numbered, segments, levels, ends, segment), "turns-edited")
    lines = materialise(repaired_rows(edited, conversations), "turns-repaired")
    per_turn = numbered.filter("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    faults = numbered.groupBy("conv_id").agg(*[F.sum((F.coalesce("fault", F.lit("")) == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")])
    report = faults
    for other in (per_turn, illegal_pairs(numbered, segments), ends.select("conv_id", F.col("total_cost").alias("cost"), F.col("total_audit").alias("audit")), digests(lines, name, kind_of)):
        report = _beside(report, other)
    nothing = hashlib.sha256(b"").hexdigest()
    return report.withColumns({"gaps": F.coalesce("gaps", F.lit(0)), "illegal": F.coalesce("illegal", F.lit(0)), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(nothing))}), lines


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with right's columns, conv_id being a key of both that may be null."""
    return left.join(right.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with every twentieth part dropped, emptied, robbed of its full stops, repeated or said by the user, by the CRC-32 of `conv_id:turn`; nulls read as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times_ = F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1)
    copies = F.array_repeat(F.lit(True), times_)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_")).drop("_")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report, _ = repair(damaged(rows))
    out = _beside(rows.select("conv_id").distinct(), report)
    none = hashlib.sha256(b"").hexdigest()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
