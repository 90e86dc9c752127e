"""Lines that documents share, filters in every order, and repair of conversations, held against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as cr
from tidemark.llm import filter_audit, keyed, line_dedup

SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Matching by key.


def test_matching_equals_a_plain_join_with_and_without_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_ROWS", 50)
    monkeypatch.setattr(keyed, "HOT_SHARE", 4)
    rng = random.Random(1)
    rows = [(rng.choice([7] * 5 + list(range(40))), i) for i in range(600)] + [(None, -1)]
    data = spark.createDataFrame(rows, "key long, i long")
    counts = data.where("key % 2 = 1").groupBy("key").agg(F.count("*").alias("n")).withColumn("more", F.col("key") * 10)
    for how in ("inner", "left"):
        got = sorted(map(tuple, keyed.matched(data, counts, "key", "n", how).select("i", "more").collect()), key=str)
        assert got == sorted(map(tuple, data.join(counts, "key", how).select("i", "more").collect()), key=str)


def test_no_row_that_matches_is_filtered(spark):
    keys = spark.range(0, 90_000, 9).select(F.xxhash64("id").alias("x"))
    rows = spark.range(0, 90_000).withColumn("_bits", F.lit(0))
    found = keyed.possible(rows, F.xxhash64("id"), keys, 10_000)
    assert found.columns == rows.columns and found.where("id % 9 = 0").count() == 10_000
    assert found.count() < 20_000
    assert keyed.possible(rows, F.xxhash64("id"), keys.limit(0), 0).count() == 0
    assert keyed.possible(rows, F.lit(None).cast("long"), keys, 10_000).count() == 0


# Lines.


def plain_lines(docs, shortest=10, least=2):
    def key(line):
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
        return k if len(k) >= shortest else None

    holders: dict = {}
    for i, (d, text) in enumerate(docs):
        for k in {key(x) for x in (text or "").split("\n")} - {None}:
            holders.setdefault(k, {})[i] = d
    first = {k: min((d for d in v.values() if d is not None), default=None) for k, v in holders.items() if len(v) >= least}
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in first or key(x) is None or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LINES = ["all rights reserved by us", "ALL rights reserved by us \t", "short", "İstanbul ÉCOLE line", "i̇stanbul école line", "\x0bunique one here\x0c", "", "  ", "ﬀ ligature line", " all rights reserved by us"]


@pytest.mark.parametrize("least", [2, 3])
def test_lines_equal_plain_python(spark, least):
    rng = random.Random(least)
    docs = [(i if i % 9 else 4, "\n".join(rng.choice(LINES) + rng.choice(["", "", str(rng.randrange(3))]) for _ in range(rng.randrange(6)))) for i in range(60)]
    docs += [(None, LINES[0]), (None, "only among rows without id"), (None, "only among rows without id"), (99, None), (98, ""), (97, "\n\n"), (3, "x" * 50_000 + "\n" + LINES[0])]
    data = spark.createDataFrame([(d, t, "z", 1) for d, t in docs], "doc_id long, text string, digests string, position int")
    got = line_dedup.deduplicated(data, least=least)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_lines(docs, least=least)


def test_a_line_of_all_documents_goes_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_ROWS", 10)
    docs = [(i, f"a line that is everywhere\nown line of number {i}\nA pair of number {i // 2}") for i in range(300)]
    got = line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_lines(docs)


def test_no_lines(spark):
    assert line_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_run_without_python(spark):
    plan = line_dedup.deduplicated(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Filters.


def plain_masks(docs):
    first: dict = {}
    for d, _, text in docs:
        t = text or ""
        if d is not None:
            first[t] = min(d, first.get(t, d))
    masks = []
    for d, part, text in docs:
        t = text or ""
        words = [w for w in re.split("[ \t-\r]+", t) if w]
        tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), t in first and (d is None or d > first[t]))
        masks.append((d, part or "", [bool(x) for x in tests]))
    return masks


def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    masks = plain_masks(docs)
    out, shapley = [], {}
    for order in map("".join, itertools.permutations("ABCDE")):
        left = list(range(len(masks)))
        for step, letter in enumerate(order, 1):
            i = "ABCDE".index(letter)
            gone = {x for x in left if masks[x][2][i]}
            for part in {m[1] for m in masks}:
                mine = [x for x, m in enumerate(masks) if m[1] == part]
                removed = [x for x in mine if x in gone]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(removed)
                kept = sum(x in left and x not in gone for x in mine)
                redundant = sum(masks[x][2][i] and x not in left for x in mine)
                unique = sum(masks[x][2][i] and sum(masks[x][2]) == 1 for x in mine)
                out.append([part, order, step, kept, len(removed), redundant, unique, sum(masks[x][0] in good for x in removed), sum(masks[x][0] in toxic for x in removed)])
            left = [x for x in left if x not in gone]
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def audit_documents():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    base = [" ".join(rng.sample(words, 120)) for _ in range(6)] + [" ".join(rng.choices(words[:20], k=130)), "UPPER CASE", "a|b", ""]
    texts = base * 3 + [base[0] + "x", base[0][:-1] + "~", "é" * 64 + "a", "é" * 64 + "b", "y" * 1500 + "1", "y" * 1500 + "2", "y" * 1500 + "1", "z" * 40_000, "z" * 40_000, "z" * 39_999 + "y"]
    docs = [(i, rng.choice(["en", "de", None, ""]), t) for i, t in enumerate(texts)]
    docs += [(None, "en", base[1]), (None, "fr", "no other text"), (None, "fr", "no other text"), (2, "de", base[2]), (2, "de", base[2]), (77, None, None), (78, "en", "")]
    labels = [(i, i % 2, (i + 1) % 3 == 0) for i in range(0, 40, 2)] + [(4, 1, True), (4, None, None), (None, 1, True)]
    return docs, [(d, q, None if x is None else int(x)) for d, q, x in labels]


def test_audit_equals_plain_python(spark):
    docs, labels = audit_documents()
    data = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, part string, text string, class string")
    got = filter_audit.audit(data, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)


@pytest.mark.parametrize("numbers", [None, 1, 3])
def test_duplicates_whatever_the_hash_and_the_block(spark, numbers):
    """With one or three values of the hash, different texts stay in one class to the end and are told apart by contents."""
    docs, _ = audit_documents()
    data = spark.createDataFrame([(d, t or "") for d, _, t in docs], "doc_id long, text string")
    hashed = F.xxhash64 if numbers is None else lambda *c: F.pmod(F.xxhash64(*c), F.lit(numbers))
    want = sorted(((m[0], t or "") for m, (_, _, t) in zip(plain_masks(docs), docs, strict=True) if m[2][4]), key=str)
    for block in (8, 64):
        got = filter_audit.duplicates(data, block, hashed)
        assert sorted(((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()), key=str) == want


def test_duplicates_of_a_very_common_text(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_ROWS", 5)
    docs = [(i, "common" if i % 3 else f"text {i // 2}") for i in range(200)]
    got = filter_audit.duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    first: dict = {}
    for d, t in docs:
        first.setdefault(t, d)
    assert sorted(map(tuple, got.select("doc_id", "first_id").collect())) == [(d, first[t]) for d, t in docs if first[t] != d]


def test_no_documents_to_audit(spark):
    none = spark.createDataFrame([], "doc_id long, part string, text string")
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


# Conversations.


def plain_kinds(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(SPACE)
        kind = cr.BLANK if not core else cr.REPEATED if (role, text) in seen else cr.CLEAN if core[-1] in ".!?" else cr.CUT
        seen.add((role, text))
        out.append(kind)
    return out


def enumerated(rows):
    """The cheapest (cost, audit, repaired) over all edits with up to two insertions in each gap."""
    kinds = plain_kinds(rows)
    gaps = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    full = {"u": "user", "a": "assistant"}
    best = None
    choices = [["D"] if k in (cr.BLANK, cr.REPEATED) else ["D", "K", "u", "a"] for k in kinds]
    for ops in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            out = [(full[x], "") for x in ins[0]]
            cost, audit = 2 * len(ins[0]), "I" * len(ins[0])
            for (role, text), kind, op, more in zip(rows, kinds, ops, ins[1:], strict=True):
                cost += {"D": 3, "K": 0}.get(op, 2) + (op != "D" and kind == cr.CUT) + 2 * len(more)
                audit += ("R" if op in "ua" else op) + "I" * len(more)
                if op != "D":
                    out.append((full.get(op, role), text))
                out += [(full[x], "") for x in more]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def swept(rows):
    """As ``enumerated`` for any length: the cheapest way to each state, row by row."""
    best: dict = {0: (0, "", [])}

    def inserted(best):
        for _ in range(3):
            more = dict(best)
            for i, (cost, audit, out) in best.items():
                for x, role in (("u", "user"), ("a", "assistant")):
                    if (i, x) in cr.NEXT:
                        way = (cost + 2, audit + "I", [*out, f"{role}:"])
                        j = cr.NEXT[i, x]
                        more[j] = min(more.get(j, way), way)
            best = more
        return best

    for (role, text), kind in zip(rows, plain_kinds(rows), strict=True):
        after: dict = {}
        for i, (cost, audit, out) in inserted(best).items():
            ways = [(i, (cost + 3, audit + "D", out))]
            if kind in (cr.CLEAN, cr.CUT):
                more = kind == cr.CUT
                ways += [(cr.NEXT[i, role[:1]], (cost + more, audit + "K", [*out, f"{role}:{text}"]))] if (i, role[:1]) in cr.NEXT else []
                ways += [(cr.NEXT[i, x], (cost + 2 + more, audit + "R", [*out, f"{r}:{text}"])) for x, r in (("u", "user"), ("a", "assistant")) if (i, x) in cr.NEXT]
            for j, way in ways:
                after[j] = min(after.get(j, way), way)
        best = after
    cost, audit, out = min(v for k, v in inserted(best).items() if k in (0, 3))
    return cost, audit, "\n".join(out)


def plain_summary(conversations, originals):
    out = []
    for conv in originals:
        rows = sorted((r for r in conversations if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        pairs = [(r[2], r[3]) for r in rows]
        kinds, turns = plain_kinds(pairs), {r[1] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, text = swept(pairs) if pairs else (0, "", "")
        out.append((conv, gaps, kinds.count(cr.BLANK), kinds.count(cr.REPEATED), kinds.count(cr.CUT), illegal, cost, audit, sha(text)))
    return sorted(out, key=str)


def rows_of(spark, conversations):
    return spark.createDataFrame([(*r, 1, "x") for r in conversations], "conv_id long, turn long, role string, text string, said int, kind string")


def summed(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def test_the_sweep_equals_all_edits():
    rng = random.Random(5)
    for _ in range(14):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "Yes.", "No", " ", "Why? "])) for _ in range(rng.randrange(4))]
        assert swept(rows) == enumerated(rows), rows


def test_matrices_are_associative():
    rng = random.Random(6)
    for _ in range(40):
        a, b, c = (cr.TURNS[rng.choice(list(cr.TURNS))] for _ in range(3))
        assert cr.product(cr.product(a, b), c) == cr.product(a, cr.product(b, c))
        assert cr.product(cr.UNIT, a) == a == cr.product(a, cr.UNIT)


@pytest.mark.parametrize(("chunk", "fan"), [(512, 64), (3, 2)])
def test_repair_equals_a_sweep(spark, chunk, fan):
    """With stretches of three turns that meet two by two, long conversations go through many levels."""
    rng = random.Random(chunk)
    conversations = []
    for conv in [*range(12), None]:
        for turn in range(rng.choice([1, 2, 5, 9, 70])):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", ""])
            conversations.append((conv, rng.choice([turn, turn, turn, turn + 100, None]), role, rng.choice(["Good.", "So it is! ", "cut off", "", "\t", f"turn {turn}.", f"turn {turn}"])))
    conversations = list({(r[0], r[1], r[2]): r for r in conversations}.values())  # turns of one place differ in role
    conversations += [r for r in conversations[::4] for _ in range(2)]  # repeated rows
    originals = [*range(14), None]
    before = spark.createDataFrame([(c,) for c in originals] * 2, "conv_id long")
    assert summed(cr.summary(rows_of(spark, conversations), before, chunk, fan)) == plain_summary(conversations, originals)


def test_repaired_turns_are_legal_and_in_order(spark):
    conversations = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Again"), (1, 2, "user", "Why?"), (2, 0, "system", "Be kind."), (3, 5, None, None)]
    report, repaired = cr.repair(rows_of(spark, conversations))
    turns: dict = {}
    for r in repaired.orderBy("conv_id", "part", "place", "seq").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in t)) for t in turns.values()) and 3 not in turns
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {c: swept([(r or " ", t or " ") for i, _, r, t in conversations if i == c])[:2] for c in (1, 2, 3)}


def test_damage_goes_by_the_checksum(spark):
    rows = [(c, t, "assistant", "A. B! c?") for c in (*range(30), None) for t in (*range(4), None)] + [(5, 7, None, None)]
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        want += [row] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert sorted(map(tuple, cr.damaged(rows_of(spark, rows)).collect()), key=str) == sorted(want, key=str)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.summary(cr.damaged(none), none.select("conv_id")).collect() == []
    some = spark.createDataFrame([(4,)], "conv_id long")
    assert summed(cr.summary(none, some)) == [(4, 0, 0, 0, 0, 0, 0, "", sha(""))]
