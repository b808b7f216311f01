"""The list search that the assembler uses by default, at its default settings and with split lists; long ways and chains."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerframe.operators import graphs, lists, reads, scoring
from kmerframe.operators.embedding import SpectrumEmbedder
from kmerframe.runtime import cut


def spectra(spark, n, length, k, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices("ACGT", k=length))) for i in range(n)]
    kmers = reads.windows(spark.createDataFrame(rows, "seq_id long, sequence string"), k).select("kmer").distinct()
    return cut(SpectrumEmbedder(2)(kmers).select(F.xxhash64("kmer").alias("id"), "embedding"))


def measured(df, k):
    """Recall of 200 rows against brute force; every cosine given must be right."""
    rows = df.toArrow()
    ids = rows["id"].to_numpy()
    x = np.array(rows["embedding"].to_pylist())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = lists.list_neighbours(df, k).toPandas()
    assert (found["query"] != found["neighbour"]).all() and not found.duplicated(["query", "neighbour"]).any()
    place = {v: i for i, v in enumerate(ids.tolist())}
    some = np.random.default_rng(1).choice(len(ids), 200, replace=False)
    hit = 0
    for i in some:
        mine = found[found["query"] == ids[i]]
        near = x @ x[i]
        assert np.allclose(near[[place[v] for v in mine["neighbour"]]], mine["cosine"], atol=1e-5)
        assert sorted(mine["rank"]) == list(range(1, len(mine) + 1))
        near[i] = -9
        hit += (mine["cosine"].to_numpy() >= -np.sort(-near)[k - 1] - 1e-5).sum()
    return hit / (k * len(some))


def test_recall_at_default_settings(spark):
    df = spectra(spark, 60, 300, 64, 1)
    assert df.count() > 20 * lists.LIST_ROWS
    assert measured(df, 39) >= 0.9


def test_split_lists(spark, monkeypatch):
    monkeypatch.setattr(lists, "LIST_ROWS", 2000)
    monkeypatch.setattr(lists, "BLOCK_ROWS", 256)
    assert measured(spectra(spark, 20, 264, 64, 2), 10) >= 0.8


def test_small_and_equal_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i < 30 else [0.0, float(i)]) for i in range(60)], "id long, embedding array<float>")
    got = {}
    for r in lists.list_neighbours(df, 3).collect():
        got.setdefault(r.query, []).append((r.rank, r.neighbour))
    assert sorted(got[7]) == [(1, 0), (2, 1), (3, 2)] and sorted(got[1]) == [(1, 0), (2, 2), (3, 3)] and sorted(got[40]) == [(1, 30), (2, 31), (3, 32)]
    assert lists.list_neighbours(df.limit(0), 3).count() == 0 and lists.list_neighbours(df.limit(1), 3).count() == 0


def test_ways_have_no_limit(spark):
    n = 70
    edges = spark.createDataFrame([(1, i, i, i + 1, "A" if i % 2 else None) for i in range(n)], "graph_id long, edge_id int, src int, dst int, label string")
    got = graphs.all_paths(edges, spark.createDataFrame([(1, 0, n)], "graph_id long, start_node int, end_node int")).collect()
    assert [len(r.path) for r in got] == [n // 2] and got[0].text == "A" * (n // 2)


@pytest.mark.parametrize("last", [0, 200_000])
def test_matching_of_a_chain(spark, monkeypatch, last):
    monkeypatch.setattr(scoring, "LAST_ROWS", last)
    rng, pairs = random.Random(3), [(i, i + 1, float(i)) for i in range(30)]
    pairs += [(a, b, round(rng.random() * 30, 1)) for a, b in ({tuple(sorted(rng.sample(range(100, 160), 2))) for _ in range(120)})]
    df = spark.createDataFrame(pairs, "gd_lo long, gd_hi long, norm_score double")
    want, taken = [], set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in taken and b not in taken:
            taken |= {a, b}
            want.append((a, b, s))
    assert sorted(tuple(r) for r in scoring.greedy_matching(df).collect()) == sorted(want)
