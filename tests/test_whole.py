"""Queries that do the whole job, on cases that a cut loses."""

import glob
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kmerframe.operators import search
from kmerframe.plans import vectors
from kmerframe.sources import fasta

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_shingles_keep_every_symbol(spark, tmp_path):
    texts = ["Año: ¡sí!\r\nÉté, naïve…", "año: ¡sí!", "aaaaaaa", "abcd", "", None, "日本語のテキスト😀x", "aaaaa\x00b", "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    n, held = Counter(), defaultdict(set)
    for i, x in enumerate(texts):
        x = (x or "").lower()
        for j in range(len(x) - 4):
            n[x[j : j + 5]] += 1
            held[x[j : j + 5]].add(i)
    got = {r.shingle: (r.n, r.documents) for r in entry.queries()["document_shingles_whole"](spark, str(tmp_path)).collect()}
    assert got == {x: (n[x], len(held[x])) for x in n}
    assert got["año: "] == (2, 2) and got["aaaaa"] == (4, 2) and "í!\r\né" in got


def test_all_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.standard_normal((240, 8))).round(1)
    x[40:90] = x[40]  # one class, larger than k
    x[100] = 2 * x[101]
    grp = np.where(np.arange(240) < 170, 1, 2)
    tops = {1: 6, 2: 8}
    rows = [(int(i) * 7, int(g), tops[int(g)], v.tolist()) for i, (g, v) in enumerate(zip(grp, x))]
    df = spark.createDataFrame(rows, "id long, grp int, k int, embedding array<float>")
    u = x.astype(np.float32).astype(np.float64)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    near = np.round(u @ u.T, 12)
    want = {(i * 7, j * 7, r) for i in range(240) for r, j in enumerate(sorted((j for j in range(240) if j != i and grp[i] == grp[j]), key=lambda j: (-near[i, j], j))[: tops[grp[i]]], 1)}
    for block in (50, 1 << 14):
        assert {(r.query, r.neighbour, r["rank"]) for r in search.all_neighbours(df, block).collect()} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_subgraphs_are_scored_over_all_vectors(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    narrow = entry.oracle_sql()["subgraph_scores"]
    assert narrow.count(vectors.FOUND) == 1
    whole = narrow.replace(vectors.FOUND, vectors.FOUND_CONFIGURED.replace(f" WHERE q.vec_id % {vectors.EVERY} = 0", ""))
    columns = ["graph_id", "target", "total", "n", "norm_score"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({whole})").fetchall()
    got = entry.queries()["subgraph_scores_whole"](spark, DATA).select(*columns).collect()
    plain = lambda r: (*r[:4], None if r[4] is None else round(float(r[4]), 4))
    assert sorted(map(str, map(plain, got))) == sorted(map(str, map(plain, want)))
    assert len(got) > len(con.sql(narrow).fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_k_is_that_of_the_configuration(spark):
    k = {r.config_id: r.k for r in vectors.top_k(spark, DATA).collect()}
    rows = entry.queries()["knn_topk_configured"](spark, DATA).join(vectors.usable(spark, DATA).select(F.col("vec_id").alias("query"), "config_id"), "query")
    most = {r.config_id: r.m for r in rows.groupBy("config_id").agg(F.max("rank").alias("m")).collect()}
    assert most and all(most[c] == k[c] for c in most) and set(most.values()) != {vectors.K}


def test_one_hot_codes_the_whole_read(spark, tmp_path):
    texts = ["ACGT" * 40 + "xN.-" + "U" * 3, "A" * 63 + "C" * 2, "ac"]
    spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string").write.parquet(str(tmp_path / "reads.parquet"))
    got = {r.seq_id: (r.known, r.cells, r.decoded) for r in entry.queries()["one_hot_roundtrip_whole"](spark, str(tmp_path)).collect()}
    assert got == {0: (163, 167 * 16, "ACGT" * 40 + "?N--???"), 1: (65, 65 * 16, texts[1]), 2: (0, 32, "??")}


def test_every_kmer_has_a_representative(spark, tmp_path):
    reads = [(3, "ACGTACGTACGTACGTACGTA"), (5, "TTTTTTTTTTTTTTTTG"), (9, "ACGTACGTACGTACGT"), (11, "ACGT")]
    spark.createDataFrame(reads, "seq_id long, sequence string").write.parquet(str(tmp_path / "reads.parquet"))
    places = defaultdict(list)
    for i, x in reads:
        for j in range(len(x) - 15):
            places[x[j : j + 16]].append((i, j))
    got = {r.kmer: (r.seq_id, r.off, r.multiplicity) for r in entry.queries()["kmer_representatives_whole"](spark, str(tmp_path)).collect()}
    assert got == {x: (*min(p), len(p)) for x, p in places.items()}
    assert got["T" * 16] == (5, 0, 1)


@pytest.mark.parametrize("split", [1, 3, 1 << 20])
def test_headers_without_data_come_back(tmp_path, split):
    text = b">a\n>b x\nGT\n>c y\n"
    (tmp_path / "x.fa").write_bytes(text)
    got = [r[2:] for s in range(0, len(text), split) for r in fasta.records(str(tmp_path / "x.fa"), s, min(len(text), s + split), last_empty=True)]
    assert got == [("a", "", ""), ("b", "x", "GT"), ("c", "y", "")]
