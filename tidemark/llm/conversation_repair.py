"""Repair of the turn structure of conversations by a min-plus matrix scan.

A conversation's roles must read: a system turn or none, then one or more pairs of user and assistant; or nothing at
all. The prefixes that can still be completed have four states (nothing yet, after system, after user, after
assistant). A turn is a 4x4 matrix from state to state of the cheapest edit (cost, then the edits' letters): the turn
is kept, given another role, or deleted, and any turns may be inserted before it, which is the closure of the insert
matrix. The product of matrices over (min, +) on costs and concatenation on letters is associative: of two edits of the
same cost, neither is a prefix of the other, as what is longer holds one more insertion, so the least letters of a part
are part of the least letters of the whole.

Rows are sorted by conversation and turn over all tasks, by range, so a long conversation lies in several partitions;
each task multiplies stretches of up to ``chunk`` turns as they pass. Conversations of several stretches go on in a
tree: ``fan`` neighbours become one, level by level, each level a written table. Down the same tree, every node hands
its children the states they begin and end in, and each stretch reads its own edits off its own letters. So no task
holds more than ``chunk`` turns or ``fan`` matrices of one conversation, but for the letters of the result.

Equal rows (conversation, turn, role, text) are counted within each task before any shuffle, as one row with a number of
copies. Texts are left out of all this: rows carry a 128-bit digest of conversation, role and text, and turns that are
kept find their texts at the end.

Defined results: turns without a number come first; rows of one turn are ordered by role, then by that digest; null
roles and texts are one space; a role counts by its first letter (one without letters is like no other); null is a
conversation of its own; an empty table gives no rows; other columns of the input aren't looked at. The digest of a
repaired conversation is a chain over its text, so ``digests`` alone passes a whole conversation through one task, as
a stream of rows in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.keyed import matched
from tidemark.llm.line_dedup import SPACES
from tidemark.llm.shared import running, written

#: Turns of a stretch, and nodes that become one.
CHUNK, FAN = 512, 64
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
#: From a state by a role's letter to the next state.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Costs of the edits Delete, Insert and Rerole (Keep has none), and of a truncated turn that isn't deleted.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: What is wrong with a row.
CLEAN, CUT, BLANK, REPEATED = range(4)

Entry = tuple[int, str] | None
Matrix = list[Entry]
NODE = "costs array<long>, audits array<string>, first string, last string, illegal long, blank long, duplicate long, truncated long"


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product of two matrices, row by row in one list; None where there is no way."""
    out: Matrix = []
    for i in range(0, 16, 4):
        for j in STATES:
            ways = [(a[i + k][0] + b[4 * k + j][0], a[i + k][1] + b[4 * k + j][1]) for k in STATES if a[i + k] is not None and b[4 * k + j] is not None]
            out.append(min(ways) if ways else None)
    return out


def least(a: Matrix, b: Matrix) -> Matrix:
    return [x if y is None or x is not None and x <= y else y for x, y in zip(a, b, strict=True)]


def edits(ways: Iterable[tuple[int, int, int, str]]) -> Matrix:
    """The matrix of the given (from, to, cost, letter)."""
    out: Matrix = [None] * 16
    for i, j, cost, letter in ways:
        out[4 * i + j] = min((cost, letter), out[4 * i + j] or (cost, letter))
    return out


UNIT = edits((i, i, 0, "") for i in STATES)
_ONE_INSERT = edits((i, NEXT[i, x], INSERT, "I") for i in STATES for x in "ua" if (i, x) in NEXT)
#: Any number of insertions: three reach every state that can be reached.
INSERTS = UNIT
for _ in range(3):
    INSERTS = least(UNIT, product(INSERTS, _ONE_INSERT))


def turn(initial: str, kind: int) -> Matrix:
    """The matrix of one row: insertions, then one edit of the row."""
    ways = [(i, i, DELETE, "D") for i in STATES]
    if kind in (CLEAN, CUT):
        more = TRUNCATED * (kind == CUT)
        ways += [(i, NEXT[i, initial], more, "K") for i in STATES if (i, initial) in NEXT]
        ways += [(i, NEXT[i, x], REROLE + more, "R") for i in STATES for x in "ua" if (i, x) in NEXT]
    return product(INSERTS, edits(ways))


TURNS = {(x, kind): turn(x, kind) for x in ("s", "u", "a", "") for kind in (CLEAN, CUT, BLANK, REPEATED)}


def deleted(a: Matrix, copies: int) -> Matrix:
    """The matrix with so many deletions after it; insertions among them are never better than behind them."""
    return [x and (x[0] + DELETE * copies, x[1] + "D" * copies) for x in a] if copies else a


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _packed(a: Matrix) -> tuple[list[int | None], list[str | None]]:
    return [x and x[0] for x in a], [x and x[1] for x in a]


def _matrix(costs: Iterable, audits: Iterable) -> Matrix:
    return [None if text is None else (int(cost), text) for cost, text in zip(costs, audits, strict=True)]


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults put in by the checksum of their conversation and turn: of
    twenty values, 0 drops the row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it
    the user's. Nulls of role and text become one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = (F.crc32(key) % 20).alias("_fault")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), fault).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")


def counted(rows: DataFrame) -> DataFrame:
    """Each different row once, with its ``copies`` and its digest ``said``, as a written table."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    whole = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.octet_length("role"), "role", "text")
    return written(once.withColumn("said", F.unhex(F.substring(F.sha2(whole, 256), 1, 32))), "turns")


def _place(turn: str) -> Column:
    """Orders turns, those without a number first."""
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def faults(turns: DataFrame) -> DataFrame:
    """The rows of ``counted`` without texts, with ``kind``: what is wrong with the first copy."""
    text = F.rtrim("text", F.lit(SPACES))
    blank, ended = text == "", F.substring(text, -1, 1).isin(".", "!", "?")
    rows = written(turns.select("conv_id", "turn", "role", "said", "copies", blank.alias("blank"), ended.alias("ended")), "faults")
    repeats = rows.where("not blank").groupBy("said").agg(F.count("*").alias("times"), F.min(_place("turn")).alias("earliest")).where("times > 1")
    rows = matched(rows, written(repeats, "repeats"), "said", "times", how="left")
    repeated = F.col("earliest").isNotNull() & (F.col("earliest") != _place("turn"))
    kind = F.when(F.col("blank"), BLANK).when(repeated, REPEATED).when(~F.col("ended"), CUT).otherwise(CLEAN)
    return written(rows.select("conv_id", "turn", "role", "said", "copies", kind.alias("kind")), "kinds")


_STRETCH = f"conv_id long, part int, place int, turns array<long>, roles array<string>, saids array<binary>, copies array<long>, kinds array<int>, {NODE}"


def _stretches(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as stretches of a conversation of up to ``chunk`` rows, each with its node."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("saids", pa.list_(pa.binary())), ("copies", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated"))])
    part = TaskContext.get().partitionId()
    place = 0

    def stretch(conv_id: int | None, rows: list[dict]) -> dict:
        matrix, before, initials = UNIT, None, [r["role"][:1] for r in rows]
        counts = dict.fromkeys(("illegal", "blank", "duplicate", "truncated"), 0)
        for r, initial in zip(rows, initials, strict=True):
            kind, copies = r["kind"], r["copies"]
            matrix = deleted(product(matrix, TURNS[initial if initial in ("s", "u", "a") else "", kind]), copies - 1)
            counts["illegal"] += copies - 1 + (before is not None and not legal(before, initial))
            counts["blank"] += copies * (kind == BLANK)
            counts["duplicate"] += copies if kind == REPEATED else (copies - 1) * (kind != BLANK)
            counts["truncated"] += kind == CUT
            before = initial
        costs, audits = _packed(matrix)
        lists = {f"{c}s" if c != "copies" else c: [r[c] for r in rows] for c in ("turn", "role", "said", "copies", "kind")}
        return {"conv_id": conv_id, "part": part, "place": place, **lists, "costs": costs, "audits": audits, "first": initials[0], "last": initials[-1], **counts}

    rows: list[dict] = []
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if rows and (r["conv_id"] != rows[0]["conv_id"] or len(rows) == chunk):
                done.append(stretch(rows[0]["conv_id"], rows))
                rows, place = [], place + 1
            rows.append(r)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if rows:
        yield pa.RecordBatch.from_pylist([stretch(rows[0]["conv_id"], rows)], schema)


def stretches(kinds: DataFrame, chunk: int) -> DataFrame:
    """All rows as stretches, in the order of ``index`` within each conversation, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _stretches(batches, chunk)

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")]
    rows = written(kinds.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _STRETCH), "stretches")
    return written(running(rows, ["conv_id"], "part", [F.col("place")], F.lit(1), "index"), "indexed")


def _joined(nodes: list[dict]) -> dict:
    """Neighbouring nodes as one."""
    matrix, out = UNIT, dict.fromkeys(("illegal", "blank", "duplicate", "truncated"), 0)
    for i, x in enumerate(nodes):
        matrix = product(matrix, _matrix(x["costs"], x["audits"]))
        for c in out:
            out[c] += x[c]
        out["illegal"] += i > 0 and not legal(nodes[i - 1]["last"], x["first"])
    costs, audits = _packed(matrix)
    return {"costs": costs, "audits": audits, "first": nodes[0]["first"], "last": nodes[-1]["last"], **out}


def _up(nodes: DataFrame, fan: int) -> DataFrame:
    """One level of the tree: each ``fan`` neighbours as one node."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("index").to_dict("records")
        conv_id = rows[0]["conv_id"]
        return pd.DataFrame([{"conv_id": None if pd.isna(conv_id) else conv_id, "index": rows[0]["index"] // fan, **_joined(rows)}])

    names = ["conv_id", "index", "costs", "audits", "first", "last", "illegal", "blank", "duplicate", "truncated"]
    return nodes.select(*names).groupBy("conv_id", F.expr(f"index div {fan}")).applyInPandas(join, f"conv_id long, index long, {NODE}")


def _down(nodes: DataFrame, parents: DataFrame, fan: int) -> DataFrame:
    """(conv_id, index, enter, leave): the states in which the cheapest way enters and leaves each node, from those of
    ``parents``."""

    def trace(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("index").to_dict("records")
        best: list[tuple[int, str, list[int]] | None] = [None] * 4
        best[rows[0]["enter"]] = (0, "", [rows[0]["enter"]])
        for x in rows:
            matrix = _matrix(x["costs"], x["audits"])
            best = [min(((b[0] + matrix[4 * i + j][0], b[1] + matrix[4 * i + j][1], [*b[2], j]) for i, b in enumerate(best) if b is not None and matrix[4 * i + j] is not None), default=None) for j in STATES]
        way = best[rows[0]["leave"]][2]
        conv_id = None if pd.isna(rows[0]["conv_id"]) else rows[0]["conv_id"]
        return pd.DataFrame({"conv_id": pd.array([conv_id] * len(rows), "Int64"), "index": [x["index"] for x in rows], "enter": way[:-1], "leave": way[1:]})

    wanted = parents.select(F.col("conv_id").alias("_conv"), F.col("index").alias("_parent"), "enter", "leave")
    rows = nodes.withColumn("_up", F.expr(f"index div {fan}"))
    rows = rows.join(wanted, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_up") == F.col("_parent")))
    return rows.select("conv_id", "index", "_up", "costs", "audits", "enter", "leave").groupBy("conv_id", "_up").applyInPandas(trace, "conv_id long, index long, enter int, leave int")


def _endings() -> list[tuple[int, int, str]]:
    """(state, cost, letters) of the insertions that complete a conversation from each state."""
    ways = []
    for i in STATES:
        found = [x for j in (START, ASSISTANT) if (x := INSERTS[4 * i + j]) is not None]
        ways.append((i, *min(found)))
    return ways


def _completed(tops: DataFrame) -> DataFrame:
    """Nodes of whole conversations with ``cost``, ``audit``, the state they end in before the last insertions, and those."""
    ways = F.array(*(F.struct((F.get("costs", F.lit(i)) + cost).alias("cost"), F.concat(F.get("audits", F.lit(i)), F.lit(text)).alias("audit"), F.lit(i).alias("leave"), F.lit(text).alias("ending")) for i, cost, text in _endings()))
    return tops.withColumn("way", F.array_min(F.filter(ways, lambda x: x["cost"].isNotNull()))).select("*", "way.*").drop("way").withColumn("enter", F.lit(START))


_REPAIRED = "conv_id long, part int, place int, seq int, role string, turn long, said binary"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of each stretch after its edits; inserted ones have no digest."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("seq", pa.int32()), ("role", pa.string()), ("turn", pa.int64()), ("said", pa.binary())])
    wanted = {USER: "assistant"}
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            state, seq, rows = x["enter"], 0, ((t, r, s, i) for t, r, s, n in zip(x["turns"], x["roles"], x["saids"], x["copies"], strict=True) for i in range(n))
            for letter in x["audits"][4 * x["enter"] + x["leave"]] + (x["ending"] or ""):
                at, role, said = None, wanted.get(state, "user"), None
                if letter != "I":
                    at, own, said, _ = next(rows)
                    role = own if letter == "K" else role
                if letter != "D":
                    out.append({"conv_id": x["conv_id"], "part": x["part"], "place": x["place"], "seq": seq, "role": role, "turn": at, "said": said})
                    state, seq = NEXT[state, role[:1]], seq + 1
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation, and its repaired turns.

    The first table has a row for each conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit. The second: conv_id, part, place and seq, by which its rows are ordered,
    role and text."""
    turns = counted(rows)
    base = stretches(faults(turns), chunk)
    levels = [base]
    last = base.agg(F.max("index")).first()[0] or 0
    while last:
        known = levels[-1].join(levels[-1].where("index > 0").select(F.col("conv_id").alias("_conv")).distinct(), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
        levels.append(written(_up(known, fan), "nodes"))
        last //= fan
    # A conversation's top is its only node of the level on which it has one.
    tops = []
    for i, level in enumerate(levels):
        more = level.where("index > 0").select(F.col("conv_id").alias("_conv")).distinct()
        whole = level.join(more, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti") if i + 1 < len(levels) else level
        tops.append(written(_completed(whole).drop("turns", "roles", "saids", "copies", "kinds", "part", "place"), "tops"))
    ways = tops[-1].select("conv_id", "index", "enter", "leave")
    for i in range(len(levels) - 2, -1, -1):
        below = _down(levels[i], ways, fan).unionByName(tops[i].select("conv_id", "index", "enter", "leave"))
        ways = written(below, "ways")
    found = tops[0]
    for x in tops[1:]:
        found = found.unionByName(x)

    same = lambda a: F.col("conv_id").eqNullSafe(F.col(a))
    ways = ways.select(F.col("conv_id").alias("_conv"), F.col("index").alias("_index"), "enter", "leave")
    ends = base.groupBy("conv_id").agg(F.max("index").alias("_last")).join(found.select(F.col("conv_id").alias("_conv"), "ending"), same("_conv")).select(F.col("conv_id").alias("_of"), "_last", "ending")
    chosen = base.join(ways, same("_conv") & (F.col("index") == F.col("_index"))).join(ends, same("_of") & (F.col("index") == F.col("_last")), "left")
    applied = chosen.select("conv_id", "part", "place", "turns", "roles", "saids", "copies", "audits", "enter", "leave", "ending").mapInArrow(_applied, _REPAIRED)
    texts = turns.select(F.col("said").alias("_said"), F.col("turn").alias("_turn"), "text")
    repaired = applied.join(texts, (F.col("said") == F.col("_said")) & F.col("turn").eqNullSafe(F.col("_turn")), "left")
    repaired = repaired.select("conv_id", "part", "place", "seq", "role", F.coalesce("text", F.lit("")).alias("text"))

    numbers = turns.groupBy("conv_id", "turn").agg(F.count("*")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    report = found.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    report = report.join(numbers.withColumnRenamed("conv_id", "_conv"), same("_conv")).select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("cost").cast("long").alias("cost"), "audit")
    return report, repaired


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    current, chain = None, None
    for batch in batches:
        done = []
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if chain is not None and conv_id != current:
                done.append({"conv_id": current, "repaired_sha256": chain.hexdigest()})
                chain = None
            line = f"{role}:{text}".encode()
            if chain is None:
                current, chain = conv_id, hashlib.sha256(line)
            else:
                chain.update(b"\n" + line)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if chain is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": chain.hexdigest()}], schema)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the conversations of ``repaired``: of role:text of all turns, joined by newlines."""
    order = [F.col("conv_id"), F.col("part"), F.col("place"), F.col("seq")]
    return repaired.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def summary(rows: DataFrame, before: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """A row for each conversation of ``before`` (conv_id): the report on ``rows``, and the digest of what they become;
    zeros, no letters and the digest of nothing for those without rows."""
    report, repaired = repair(rows, chunk, fan)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = [F.lit(None).cast("long").alias(c) for c in counts]
    parts = [
        before.select(F.col("conv_id").cast("long").alias("conv_id"), *nothing, F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256")),
        report.withColumn("repaired_sha256", F.lit(None).cast("string")),
        digests(repaired).select("conv_id", *nothing, F.lit(None).cast("string").alias("audit"), "repaired_sha256"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("conv_id")
    one = rows.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"))
    return one.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
