"""N-gram join, components and exact dedup against plain versions."""

import random
import re
import tracemalloc
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, ngram_join, shingles
from tidemark.llm.components import _star, components, contracted

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_sets(texts, width):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def plain_components(rows, width, percent):
    sets = plain_sets([t for _, t in rows], width)
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = roots({d for d, _ in rows if d is not None}, links)
    return sorted(((d, len(s), root.get(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for length in (8, 30, 120):
        base = " ".join(rng.choice(vocab) for _ in range(length))
        texts += variants(rng, base, 25, max(1, length // 20))
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    texts += [f"{passage} {rng.randrange(10**6)} {rng.choice(vocab)}" for _ in range(20)]
    texts += ["", None, "   \t", "one", "One", "two words", "TWO\nwords", "É é", "é É", "same"] + ["Repeated text of five words"] * 12
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return [*rows, (None, "one"), rows[3], (rows[5][0], "another text with the same id")]


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3), (2, 100, 4)])
def test_join_equals_all_pairs(spark, width, percent, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "x", 0) for d, t in rows], "doc_id long, text string, n int, part string, token int").repartition(5)
    found = ngram_join.similar_components(df, ngram_join.Join(width, percent)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == plain_components(rows, width, percent)


def test_all_of_a_band_meet_its_leader(spark):
    """One band of 500 documents, and documents of bands of their own."""
    rows = [(i, float(i == 77), 5 if i < 500 else 1000 + i, *(2000 * k + i for k in range(1, len(ngram_join.ALL_BANDS)))) for i in range(600)]
    sets = spark.createDataFrame(rows, "doc_id long, common double, " + ", ".join(f"{b} long" for b in ngram_join.ALL_BANDS))
    found = {tuple(r) for r in ngram_join._leader_pairs(sets).collect()}
    assert found == {(i, 77) for i in range(500) if i != 77}


def test_copies_of_one_text_cost_few_candidates(spark, monkeypatch):
    """Every copy is like the text it was made from, but most aren't like each other: no pairs of them are candidates."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    copies = []
    for i in range(150):
        words_ = list(base)
        for place in rng.sample(range(0, 200, 6), 4):
            words_[place] = f"x{i}.{place}"
        copies.append((i, " ".join(words_)))
    docs = spark.createDataFrame([*copies, (900, " ".join(base))], "doc_id long, text string").repartition(3)
    counts, candidates = [], ngram_join._candidates

    def counted(postings, join):
        found = candidates(postings, join)
        counts.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    found = ngram_join.similar_components(docs, ngram_join.Join(5, 80)).collect()
    assert {r.component_id for r in found} == {0} and counts[0] < 400


def test_grid_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_sides", lambda classes, hot: np.where(classes > 4, 3, 1).astype(np.int32))
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.similar_components(df, ngram_join.Join(3, 80)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == plain_components(rows, 3, 80)


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


MORSE = [thue_morse(n, letters) for n in (1024, 2048, 8192) for letters in ("ab", "ba")]


def test_words_of_the_same_letters_in_another_order_are_others(spark):
    texts = [*MORSE, *(f"{a} {b}" for a, b in zip(MORSE[::2], MORSE[1::2], strict=True)), *(f"{b} {a}" for a, b in zip(MORSE[::2], MORSE[1::2], strict=True)), "abcdefgh ijklmnop", "ijklmnop abcdefgh", "abcdefghijklmnop", "ijklmnopabcdefgh"]
    rows = list(enumerate(texts))
    found = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Join(3, 90)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == plain_components(rows, 3, 90)
    assert len({int(x) for x in shingles.words(pa.array(MORSE))[0]}) == len(MORSE)


def test_words_with_equal_numbers_are_told_apart(monkeypatch):
    monkeypatch.setattr(shingles.Lanes, "numbers", lambda self: (self.sizes % 2).astype(np.uint64))
    texts = ["a b c a bb", "b a dddd a bb", "a b c", "a b", "a b", "b a", "", None, "A\tb c"]
    sets, plain = list(shingles.exact_sets(pa.array(texts), 3)), plain_sets(texts, 3)
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain[i] & plain[j]) and len(sets[i]) == len(plain[i])


def test_join_of_nothing(spark):
    assert ngram_join.similar_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shingle_sets_do_not_depend_on_batches():
    texts = ["a b c d", "", None, "A b\tC d e", "a", "x" * 5000 + " y z", "a b c d"]
    together = list(shingles.shingle_sets(pa.array(texts), 3))
    for t, s in zip(texts, together, strict=True):
        assert np.array_equal(next(iter(shingles.shingle_sets(pa.array([t], pa.string()), 3))), s)
    assert list(map(len, together)) == [len(s) for s in plain_sets(texts, 3)]
    assert np.array_equal(together[0], together[6]) and len(np.intersect1d(together[0], together[3])) == 2
    sliced = pa.array(["zz", *texts])[1:]
    assert all(map(np.array_equal, shingles.shingle_sets(sliced, 3), together))


@pytest.mark.parametrize("usual", [0, 4, 70, 600_000])
def test_frequent_shingles_stand_out_of_full_slots(usual):
    counts = np.random.default_rng(1).poisson(usual, 100_000)
    hot = usual + np.array([20_000, 1_000_000, 50_000_000])
    classes, others = ngram_join._class(hot, usual), ngram_join._class(counts, usual)
    assert (np.diff(classes.astype(int)) > 0).all() and others.max() < classes[0]
    assert np.allclose(ngram_join._beyond(classes, usual), hot - usual, rtol=0.06)
    assert (ngram_join._sides(others, usual) == 1).all() and ngram_join._sides(classes, usual).tolist()[0] in (5, 6)
    ordered = ngram_join._class(np.arange(0, 2 * usual + 50), usual).astype(int)
    assert (np.diff(ordered) >= 0).all()


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    join = ngram_join.Join(3, 90)
    classes = rng.integers(0, 5, ngram_join.SLOTS).astype(np.uint8)
    for _ in range(200):
        both = rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)
        extra = [rng.integers(0, 2**63, rng.integers(0, 1 + len(both) // 15 + 1)).astype(np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate((both, e))) for e in extra)
        if join.linked(a, b):
            for seed in ngram_join.ORDERS:
                assert len(np.intersect1d(*(ngram_join._ordered(s, seed, classes, join.prefix(len(s))) for s in (a, b))))


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(0, 900 + i) for i in range(60)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert {n: found.get(n, n) for n in want} == want


def plain_groups(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = iter([True])
        out += [(d, keep, len(ids), d == keep and next(kept, False), sha256(text.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [exact_dedup.BUDGET_BYTES, 2000])
def test_exact_groups(spark, budget):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Abc", "abC", "", None, "É", "é", " abc", "long " * 300, "Long " * 300, f"own {i}", "x" * 5000])) for i in range(300)]
    rows += [(None, "abc"), (None, "only without id"), rows[0], (7, "shared id")]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, content string, size int").repartition(4)
    found = exact_dedup.exact_groups(df, budget)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found.collect()), key=str) == plain_groups(rows)
    kept = exact_dedup.deduplicated(df, budget)
    assert kept.columns == df.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for _, t in rows})
    best = {(t or "").translate(LOWER): max((x for x, y in rows if (y or "").translate(LOWER) == (t or "").translate(LOWER) and x is not None), default=None) for _, t in rows}
    assert all(best[(r.text or "").translate(LOWER)] == r.doc_id for r in kept.collect())


def test_grace_spills_and_cleans(tmp_path):
    records = [(hash(("h", i % 50)) & (1 << 64) - 1, f"content {i % 50}".encode() * 20, i) for i in range(500)]
    same_hash = [(5, f"c{i % 40}".encode() * 100, i) for i in range(80)]
    for name, rows, budget in (("s", records, 1000), ("t", same_hash, 500)):
        found = [x[1:] for x in exact_dedup.grace(iter(rows), budget, tmp_path / name) if x]
        assert sorted(found, key=lambda x: x[1]) == [(c, i) for _, c, i in rows]
        numbers, bucket = {}, 0
        for x in exact_dedup.grace(iter(rows), budget, tmp_path / f"{name}2"):
            if x is None:
                bucket += 1
            else:
                assert numbers.setdefault((bucket, x[0]), x[1]) == x[1]
        assert len(numbers) == len(set(numbers.values())) == len({c for _, c, _ in rows}) and bucket > 1
        groups = list(exact_dedup.grace_groups(iter(rows), budget, tmp_path / f"{name}3"))
        assert sorted(map(sorted, groups)) == sorted([i for _, c, i in rows if c == x] for x in {c for _, c, _ in rows})
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_copies_take_no_memory(spark, tmp_path):
    tracemalloc.start()
    rows = sum(1 for x in exact_dedup.grace(((7, b"", i) for i in range(400_000)), 1 << 20, tmp_path / "s") if x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 400_000 and peak < 1 << 20
    n = 300_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).coalesce(1)
    found = exact_dedup.exact_groups(docs).agg(F.count("*"), F.min("group_size"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(found) == (n, n, n - 1, 1)


def test_nothing_to_dedup(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(empty).collect() == [] and exact_dedup.deduplicated(empty).collect() == []


def test_the_orders_alone_find_what_bands_find(spark):
    """Near copies of some texts, in chains and in one large group: the same components with and without bands."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(80)]
        for _ in range(rng.choice([1, 3, 25])):
            texts.append(" ".join(base))
            base = list(base)
            base[rng.randrange(80)] = rng.choice(words)
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "one two"])), "doc_id long, text string")
    for join in (ngram_join.Join(3, 90), ngram_join.Join(5, 80)):
        found = [sorted(map(tuple, ngram_join.similar_components(docs, join, bands=bands).collect())) for bands in (True, False)]
        assert found[0] == found[1] and len({x[2] for x in found[0]}) < len(texts)


def test_slot_counts_that_overflow_two_bytes_are_handed_on(spark):
    """One shingle in more rows of a task than two bytes count: what has been counted goes on, and nothing is lost."""
    docs = spark.range(140_000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("the same words").alias("text"))
    counts = [ngram_join._unpacked(r.counts)[1] for r in ngram_join._summaries(docs, ngram_join.Join(3, 90)).where("slot_row is not null").collect()]
    assert sum(int(c.sum()) for c in counts) == 140_000 and len(counts) >= 3
    packed = ngram_join._packed(np.array([3, 9]), np.array([5, 1 << 40]))
    assert [x.tolist() for x in ngram_join._unpacked(packed)] == [[3, 9], [5, 1 << 40]]


def plain_roots(edges):
    found = roots({x for edge in edges for x in edge}, edges)
    return sorted((node, root) for node, root in found.items() if node != root)


def tangled(rng):
    """A long chain in no order, a star, random edges, and edges that come twice or lead to their own node."""
    chain = rng.sample(range(1000, 1400), 400)
    found = list(zip(chain, chain[1:], strict=False)) + [(5, x) for x in range(2000, 2300)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    found += found[:50] + [(b, a) for a, b in found[50:90]] + [(7, 7)]
    rng.shuffle(found)
    return found


def test_components_of_one_task_take_no_step(spark, monkeypatch):
    steps = []
    monkeypatch.setattr("tidemark.llm.components._star", lambda edges, small, star=_star: steps.append(small) or star(edges, small))
    edges = tangled(random.Random(3))
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == plain_roots(edges)
    assert not steps


def test_components_over_many_tasks_and_small_pieces(spark, monkeypatch):
    steps = []
    monkeypatch.setattr("tidemark.llm.components._star", lambda edges, small, star=_star: steps.append(small) or star(edges, small))
    monkeypatch.setattr("tidemark.llm.components.contracted", lambda edges: contracted(edges.repartition(7), 16))
    edges = tangled(random.Random(4))
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == plain_roots(edges)
    assert steps


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([(3, 3), (None, 1)], "a long, b long")).collect() == []
