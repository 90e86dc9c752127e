"""The registered queries and the pipeline against oracles and plain versions."""

import math
import os
import shutil
import subprocess
import sys
import zlib
from hashlib import sha256
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.test_oracles import SF, TABLES, compared
from tidemark.llm import language_id, mixing, quality_gam, queries
from tidemark.llm.shared import written

from .test_pairs_and_copies import plain_components, plain_groups
from .test_search_shards_mix import plain_shards

ROOT = Path(__file__).resolve().parent.parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    compared(spark, duck, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_a_row_for_each_document(spark, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count() and found.doc_id.is_unique


def digest(x):
    return sha256(x.encode()).hexdigest()


def test_token_queries_equal_the_library(spark):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    found = queries.op3_bpe_round_trip(spark, SF).collect()
    assert {tuple(r) for r in found} == {(d, len(i), digest(",".join(map(str, i))), digest(library.decode(i, skip_special_tokens=False))) for d, i in ids.items()}
    want, start = set(), 0
    for d in sorted(ids):
        whole = [*ids[d], 0]
        want.add((d, start, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes())))
        start += len(whole)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_files(spark, SF).collect()} == want


def test_sharding_query_equals_a_plain_deal(spark):
    rows = [(r.doc_id, r.source, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    keys = {d: f"{d}:{zlib.crc32(t.encode())}:{len(t.encode()) + 16}" for d, _, t in rows}
    want = plain_shards([(keys[d], s, 0) for d, s, _ in rows], 40)
    found = queries.op7_sharding(spark, SF).collect()
    assert {(r.doc_id, r["shard"], r.slot) for r in found} == {(d, *want[keys[d]]) for d, _, _ in rows}
    assert all(keys[r.doc_id] == f"{r.doc_id}:{r.text_crc32}:{r.size}" and r.law == "rows" and r.grown_shard is None for r in found)


def plain_score(model, x):
    """Bins by counting edges, and a sum of look-ups."""
    bins = [sum(v >= e for e in edges) for v, edges in zip(x.tolist(), model.edges, strict=True)]
    total = model.base + sum(model.tables[i][b] for i, b in enumerate(bins)) + sum(t[bins[a], bins[b]] for (a, b), t in model.pairs.items())
    return 1 / (1 + math.exp(-total))


def test_quality_scores_equal_single_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = language_id.fold("doc_id", 4) == 2
    model = quality_gam.learn(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~held))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = queries.op6_quality_gam(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        x = quality_gam.features(pa.array([texts[r.doc_id]], pa.string()))[0]
        assert r.score == pytest.approx(plain_score(model, x), abs=1e-6) and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def odd_documents(spark):
    base = " ".join(f"word{i}" for i in range(40))
    texts = [base, base.upper(), base + " more", base.replace("word3 ", "other "), None, "", "12 34", "Le chat est là", "short text", "Short text", *(f"the cat number {i} sat on a mat" for i in range(40))]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None)[i % 3], i, "extra") for i, t in enumerate(texts)] + [(None, "without any id", "en", "s1", 1, "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")


def test_stages_equal_plain_versions(spark):
    docs = odd_documents(spark)
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), "stage"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in kept[:-1]]
    assert sorted(rows[1], key=str) == sorted(((d, t) for d, t in rows[0] if any(c.isalpha() for c in t or "")), key=str)
    stays = {(d, s) for d, k, _, kept_, s in plain_groups(rows[1]) if kept_}
    assert len(rows[2]) == len({s for _, s in {(d, s) for d, _, _, _, s in plain_groups(rows[1])}}) and {d for d, _ in rows[2] if d is not None} == {d for d, _ in stays if d is not None}
    root = {d: c for d, _, c in plain_components(rows[2], 5, 80)}
    assert sorted(rows[3], key=str) == sorted(((d, t) for d, t in rows[2] if d is None or root[d] == d), key=str)
    taken = {r.doc_id: -(-r.taken // r["size"]) for r in mixing.mix_sources(kept[3].select("doc_id", "source", mixing.word_count("text").alias("size"))).collect()}
    assert all(sum(x == (d, t) for x in rows[4]) == taken[d] for d, t in rows[3])
    last = kept[-1].collect()
    assert len(last) == len(rows[4]) and all(r.same and r.n_tokens == len(r.ids) for r in last)


def test_columns_named_like_helpers_pass_through(spark):
    names = ["score", "lang_pred", "Lang_Pred_", "_hash", "_times", "_copy", "size", "taken", "component_id", "n"]
    docs = odd_documents(spark).where("doc_id is not null").select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "named")
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names)
    assert corpus_pipeline.encode(spark, docs, SF).where("not same").count() == 0


def test_pipeline_runs_over_whole_tables(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and found.where("not same").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding"]


def test_stages_take_nothing(spark):
    docs = odd_documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "none")
    assert docs.count() == 0


def test_labels_do_not_reach_predictions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = language_id.fold("doc_id", 5) == 0
    profiles = language_id.learn(docs.where(~held))
    blind = language_id.predict(docs.drop("lang", "source"), profiles).select("doc_id", "lang_pred", "score")
    assert blind.exceptAll(language_id.predict(docs, profiles).select("doc_id", "lang_pred", "score")).count() == 0


def test_the_rest_works_without_this_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'quality_rank_asof' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; e.oracle_sql(); "
    code += "from tidemark.session import session; s = session('rest', spark__master='local[2]', spark__ui__enabled='false', spark__sql__shuffle__partitions='2'); assert e.entry(s).count() > 0"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r"), "PYSPARK_PYTHON": sys.executable}, timeout=180)
