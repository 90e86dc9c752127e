"""MaxScore, sharding and mixing against plain versions and their laws."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import maxscore, mixing, sharding


def plain_best(rows, k):
    vectors = {}
    for d, v in rows:
        if d is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(1024 * float(np.float32(x))) for x in v]
            vectors[d] = max(vectors.get(d, w), w)
    out = []
    for q in sorted(d for d in vectors if d % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), d) for d, v in vectors.items() if d != q and len(v) == len(vectors[q]))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("spread", [1.0, 0.002])
def test_best_equal_all_scores(spark, monkeypatch, spread):
    monkeypatch.setattr(maxscore, "SHARD_BYTES", 60 * 12 * 10)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 16)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, spread) for _ in range(12)]) for i in range(300)]
    rows += [(i, [0.5] * 12) for i in range(300, 340)] + [(400, None), (401, []), (410, [1.0, None] * 6), (420, [float("nan")] * 12), (430, [float("inf")] * 12), (None, [0.1] * 12)]
    rows += [rows[0], (10, [9.0] * 12), (440, [0.25] * 3), (441, [0.5] * 3), (450, [0.0] * 12), (460, [1.0])]
    df = spark.createDataFrame([(d, v, 7) for d, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    found = maxscore.top_k(maxscore.integer_vectors(df), F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == plain_best(rows, 5)


def test_scores_beyond_doubles_are_exact():
    rng = random.Random(2)
    for size in (2**30, 2**53, 2**61):
        rows = [[rng.randint(-size, size) for _ in range(3)] for _ in range(60)]
        rows += [[size, 1, 0], [size, 0, 0], [size, 0, 0]]
        shard = maxscore.Shard(np.arange(len(rows)), np.array(rows, np.int64))
        for q in range(len(rows)):
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(rows[q], v, strict=True)))), i) for i, v in enumerate(rows) if i != q)
            exact = sorted((-sum(a * b for a, b in zip(rows[q], v, strict=True)), i) for i, v in enumerate(rows) if i != q)
            ids, found = shard.best(q, np.array(rows[q], np.int64), 5)
            assert ids.tolist() == [i for _, i in exact[:5]] and found.tolist() == [-s for s, _ in scores[:5]]


def test_vectors_beyond_long(spark):
    df = spark.createDataFrame([(10, [1e30, -1e30]), (20, [1e30, 1.0]), (30, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert maxscore.top_k(maxscore.integer_vectors(df), F.col("vec_id") % 10 == 0, 5).count() == 6


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.top_k(maxscore.integer_vectors(empty), F.col("vec_id") % 10 == 0).collect() == []


def documents(n):
    rng = random.Random(2)
    return [(i, rng.choice(["hot"] * 6 + ["a", "b", "ä", None]), rng.randint(0, 400)) for i in range(n)]


def test_shards_match_the_mixture(spark):
    rows = documents(5000)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, size long, shard int")
    found = sharding.interleaved_shards(df, 40).toPandas()
    again = sharding.interleaved_shards(df.repartition(7), 40).toPandas()
    assert dict(zip(found.doc_id, zip(found["shard"], found.slot, strict=True), strict=True)) == dict(zip(again.doc_id, zip(again["shard"], again.slot, strict=True), strict=True))
    sizes = found.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    by = found.fillna({"source": "none"}).groupby(["source", "shard"]).size().unstack(fill_value=0)
    share = by.sum(axis=1) / len(rows)
    assert (by.sub(by.sum(axis=1) / 40, axis=0).abs().max(axis=1) <= 1 + share * len(by)).all()


def plain_shards(rows, shards, seed="shards"):
    """{doc_id: (shard, slot)} by sorting everything: rank by MD5 within the source, then fractional ranks, then cuts."""
    by_source = {}
    for d, s, _ in rows:
        by_source.setdefault(s, []).append((hashlib.md5(f"{seed}:{d}".encode()).hexdigest(), d))
    order = []
    for s, some in by_source.items():
        order += [((2 * i + 1) / (2 * len(some)), s is None, (s or "").encode(), key, d) for i, (key, d) in enumerate(sorted(some))]
    places = {x[-1]: i for i, x in enumerate(sorted(order))}
    out = {}
    for d, i in places.items():
        shard = i * shards // len(rows)
        out[d] = (shard, i - -(-shard * len(rows) // shards))
    return out


def test_shards_are_dealt_in_the_order_of_fractional_ranks(spark):
    rows = documents(3000)
    columns = ["_key", "_bucket", "_rank", "_rows", "_share", "_place", "_before", "_offset", "_sum", "_of_source", "slot", "Shard"]
    df = spark.createDataFrame([(*r, *columns) for r in rows], "doc_id long, source string, size long, " + ", ".join(f"{c} string" for c in columns))
    found = sharding.interleaved_shards(df, 40).collect()
    assert {r.doc_id: (r["shard"], r.slot) for r in found} == plain_shards(rows, 40)
    assert all(r[c] == c for r in found for c in columns[:-2]) and len(found[0]) == 3 + len(columns)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_rows_for_many_shards(spark, n):
    df = spark.createDataFrame([(None if i == 3 else i, None, 1) for i in range(n)] + [(1, "x", 1)] * (n > 1), "doc_id long, source string, size long")
    found = sharding.interleaved_shards(df, 40).collect()
    assert len(found) == df.count() and all(r.slot == 0 for r in found) and len({r["shard"] for r in found}) == len(found)


def plain_targets(sizes, budget=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_meets_targets(spark):
    rows = documents(3000) + [(9000, "empty", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    found = mixing.mix_sources(df).toPandas()
    again = mixing.mix_sources(df.repartition(9)).toPandas()
    assert dict(zip(found.doc_id, found.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = plain_targets(sizes)
    assert (found.taken <= 2 * found["size"]).all() and (found.taken >= 0).all()
    for s, g in found.assign(source=found.source.where(found.source.notna(), None)).groupby(found.source.fillna("none")):
        key = None if s == "none" else s
        assert g.source_size.iloc[0] == sizes[key] and g.target.iloc[0] == pytest.approx(want[key])
        assert g.taken.sum() == math.floor(want[key] + 1e-6)


def test_schedule_is_even_from_the_start(spark):
    goals = spark.createDataFrame([("a", 60_000.0), ("b", 30_000.0), (None, 10_000.0)], "source string, target double")
    found = mixing.schedule(goals, 10).orderBy("slot").collect()
    slots = [r.slot for r in found]
    assert len(set(slots)) == len(slots) == 10_000 and slots[-1] < 10_010
    for start in range(0, 10_000, 500):
        part = [r.source for r in found if start <= r.slot < start + 500]
        assert all(abs(part.count(s) - 500 * share) <= 5 for s, share in (("a", 0.6), ("b", 0.3), (None, 0.1)))
    for s, n in (("a", 6000), ("b", 3000), (None, 1000)):
        assert [(r.block, r.words) for r in found if r.source == s] == [(j, 10) for j in range(n)]


def test_schedule_meets_odd_targets(spark):
    targets = {f"s{i:03}": 3.7 * i for i in range(300)} | {None: 10_003.2}
    found = mixing.schedule(spark.createDataFrame(list(targets.items()), "source string, target double"), 100).collect()
    assert len({r.slot for r in found}) == len(found)
    for s, t in targets.items():
        own = sorted((r.block, r.words) for r in found if r.source == s)
        assert [b for b, _ in own] == list(range(len(own))) and sum(w for _, w in own) == math.floor(t)


def test_pieces_cover_every_word_once_an_epoch(spark):
    rows = documents(200) + [(5, "a", 30), (5, "a", 30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    pieces = mixing.laid_out(df, 2, 64, "seed").collect()
    for epoch in (0, 1):
        assert sum(p.end - p.first for p in pieces if p.epoch == epoch) == sum(n for _, _, n in rows)
    assert all(0 <= p.first < p.end <= p["size"] for p in pieces)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string, size long")).collect() == []
    assert mixing.mix_sources(spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")).select("taken").distinct().collect()[0][0] == 0


def test_repeated_keeps_whole_rows(spark):
    df = spark.createDataFrame([(i, "w " * (i % 50), "ab"[i % 2], i) for i in range(300)] + [(999, None, None, 1)], "doc_id long, text string, source string, n_chars long")
    found = mixing.repeated(df)
    assert found.columns == df.columns
    times = found.groupBy("doc_id").count().toPandas()
    assert times["count"].max() <= 2 and 999 not in set(times.doc_id)


def test_repeated_counts_rows_without_or_with_equal_ids(spark):
    rows = [((None, 7, i)[i % 3], f"w{i} " * (1 + i % 90), "ab"[i % 2], i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    found = mixing.repeated(df, weights=(1,), budget=2.0, cap=2).collect()
    assert len(found) == 600 and all(found.count(r) == 2 for r in df.collect())
    some = mixing.repeated(df, weights=(5, 2, 1), budget=1.5, cap=2)
    counts = [n for _, n in mixing.mix_sources(df.select("doc_id", "source", mixing.word_count("text").alias("size"))).select("doc_id", F.ceil(F.col("taken") / F.col("size"))).collect()]
    again = mixing.repeated(df.repartition(7), weights=(5, 2, 1), budget=1.5, cap=2)
    assert some.count() == sum(counts) and some.where("doc_id is null").count() > 0 and some.exceptAll(again).count() == again.exceptAll(some).count() == 0


def test_very_many_sources_of_one_row(spark):
    """All fractions are 1/2: the order goes by the source, counts differ by one at most, and tasks share the rows."""
    n = 3000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("host%05d", F.pmod(F.xxhash64("id"), F.lit(10**5))).alias("source")).dropDuplicates(["source"])
    n = rows.count()
    got = sharding.interleaved_shards(rows, 7).orderBy("shard", "slot").collect()
    assert [r.source for r in got] == sorted(r.source for r in got)
    sizes = [sum(r.shard == k for r in got) for k in range(7)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and [r.slot for r in got if r.shard == 3] == list(range(sizes[3]))


def test_schedule_of_very_many_sources_equals_a_search(spark):
    """Each slot is in the share that its point falls in, also where one cell has hundreds of shares."""
    rng = random.Random(7)
    goals = [(None if i == 0 else f"s{i:04}", float(rng.choice([3, 40, 900, 30_000 if i == 9 else 5]))) for i in range(800)]
    found = mixing.schedule(spark.createDataFrame(goals, "source string, target double"), 16).collect()
    order = sorted(goals, key=lambda g: (g[0] is None, g[0] or ""))
    ends, total = [], 0.0
    for _, t in order:
        total += t
        ends.append(total)
    bounds = [int(e / total * mixing.POINTS) for e in ends[:-1]] + [mixing.POINTS]
    words: dict = {}
    for r in found:
        words[r.source] = words.get(r.source, 0) + r.words
        if r.slot < -(-total // 16):
            at = next(k for k, b in enumerate(bounds) if r.slot * mixing.GOLDEN % mixing.POINTS < b)
            assert r.source == order[at][0]
    assert words == {s: int(t) for s, t in goals}
