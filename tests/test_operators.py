import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerframe.config import AssemblerConfig, AssemblyState, SequenceType
from kmerframe.operators import graphs as G
from kmerframe.operators import reads as R
from kmerframe.operators import scoring, search, training
from kmerframe.operators.embedding import SpectrumEmbedder, one_hot_rows
from kmerframe.plans.assembler import Assembler

GOLDEN = ["ACGTTGCAACGT", "TGCAACGTGGAC", "ACGTTGCAACGT", "GGACCTTAGGCA", "TTTTTTTT", "ACG"]


def test_reads(spark):
    df = spark.createDataFrame([("p", i, "", None, s, None) for i, s in enumerate(GOLDEN, 1)] + [("p", 9, "", None, None, None), ("p", 10, "", None, "", None)], "path string, ordinal long, name string, description string, data string, loaded_at timestamp")
    got = R.deduplicated(df)
    assert sorted((r.ordinal, r.instances) for r in got.collect()) == [(1, 2), (2, 1), (4, 1), (5, 1), (6, 1)]
    assert sorted((r.seq_id, r.ordinal) for r in R.deduplicated(df, dense=True).collect()) == [(1, 1), (2, 2), (3, 4), (4, 5), (5, 6)]
    reads = got.select(F.col("ordinal").alias("seq_id"), "sequence")
    reprs = {r.kmer: ((r.seq_id, r.off), r.multiplicity) for r in R.representatives(R.windows(reads, 6)).collect()}
    assert len(reprs) == 19 and sum(n for _, n in reprs.values()) == 24
    assert reprs["TGCAAC"] == ((1, 4), 2) and reprs["TTTTTT"] == ((5, 0), 3)
    texts = R.text_at(spark.createDataFrame([(1, 4), (77, 0)], "seq_id long, off int"), reads, 6).collect()
    assert {r.seq_id: r.kmer for r in texts} == {1: "TGCAAC", 77: None}
    assert R.deduplicated(df.limit(0)).count() == 0


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = sorted((r.k, r.n) for r in R.numbered(df, ["k"], "n").collect())
    assert [n for _, n in got] == list(range(1, 1001))


def test_assembler_golden(spark):
    config = AssemblerConfig(kmer_len=6, knn_top_k=5, seqemb_onnx_path=None, subgraph_join_threshold=5.0)
    for itself, want in ((True, {1: (1, 75.8333), 2: (1, 57.5), 4: (4, 75.8333), 5: (1, 40.0), 6: (None, None)}), (False, {1: (2, 13.5), 2: (1, 57.5), 4: (2, 5.1667), 5: (1, 40.0), 6: (None, None)})):
        run = Assembler(spark, config, SpectrumEmbedder(2), exact=True, itself=itself)
        run.start_reads(GOLDEN)
        status = run.wait(300)
        assert status.state is AssemblyState.COMPLETE, status.error
        assert (status.records, status.reads, status.kmers, status.alignments) == (6, 5, 19, 46)
        best = {r.graph_id: (r.target, None if r.norm_score is None else round(r.norm_score, 4)) for r in run.results["best"].collect()}
        assert best == want
        assert run.results["candidates"].count() == 76
        histogram = {r.score: r["count"] for r in run.results["alignments"].groupBy("score").count().collect()}
        assert histogram == {10: 6, 11: 1, 12: 1, 15: 1, 16: 2, 17: 3, 20: 14, 22: 2, 25: 16}
        assert min(status.seconds.values()) >= 0
    assert [(r.gd_lo, r.gd_hi) for r in run.results["queue"].collect()] == [(1, 2), (1, 5), (2, 4)]
    assert run.results["path_scores"].count() == 3
    with pytest.raises(ValueError):
        run.start_reads(["MAAT"], SequenceType.AMINO_ACID)
    run.start_async("/nonexistent/*.fa")
    assert run.wait(120).state in (AssemblyState.COMPLETE, AssemblyState.ERROR)


def test_assembler_abort(spark):
    run = Assembler(spark, AssemblerConfig(kmer_len=8, knn_top_k=5, seqemb_onnx_path=None), SpectrumEmbedder(2))
    rng = random.Random(1)
    run.start_reads(["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(200)])
    run.abort()
    assert run.wait(120).state is AssemblyState.ABORTED
    with pytest.raises(KeyError):
        AssemblerConfig.from_dict({"kmer_length": 3})
    assert AssemblerConfig.from_dict({"kmer_len": 32}).kmer_len == 32


def test_exact_and_hashed_search(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 300)] + 0.1 * rng.standard_normal((300, 16))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    got = search.exact_neighbours(rows.where("id % 10 = 0"), rows, 4).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 300, 10):
        sims = unit @ unit[q]
        sims[q] = -9
        assert [r.neighbour for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == list(np.argsort(-sims, kind="stable")[:4])
    pairs = {(r.a, r.b) for r in search.hashed_candidates(rows, tables=12, bits=6, dim=16).collect()}
    hit = sum((min(q, r), max(q, r)) in pairs for q, r in ((g["query"], g.neighbour) for g in got))
    assert hit / len(got) > 0.9
    assert search.exact_neighbours(rows.limit(0), rows, 3).count() == 0


def test_one_hot_rows():
    rows = one_hot_rows(["AC", "-x"], "ACGTRYSWKMBDHVN", ".-")
    assert rows.shape == (2, 2, 16) and rows[0, 0, 0] == rows[0, 1, 1] == rows[1, 0, 15] == 1 and rows.sum() == 3


def test_matching_is_greedy(spark):
    rng = random.Random(3)
    rows = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(200)})
    joins = [(a, b, float(rng.randrange(5))) for a, b in rows]
    taken, want = set(), set()
    for a, b, s in sorted(joins, key=lambda r: (-r[2], r[0], r[1])):
        if a not in taken and b not in taken:
            taken |= {a, b}
            want.add((a, b, s))
    got = scoring.greedy_matching(spark.createDataFrame(joins, "gd_lo long, gd_hi long, norm_score double"))
    assert {tuple(r) for r in got.select("gd_lo", "gd_hi", "norm_score").collect()} == want
    assert scoring.greedy_matching(spark.createDataFrame([], "gd_lo long, gd_hi long, norm_score double")).count() == 0


def test_usable_joins(spark):
    rows = [(2, 1, 5.0, 1), (1, 2, 7.0, 2), (1, 2, 6.0, 2), (3, 3, 9.0, 1), (4, None, 9.0, 1), (5, 6, float("nan"), 1), (5, 7, None, 1)]
    df = spark.createDataFrame(rows, "gd_lo long, gd_hi long, norm_score double, scored_at int")
    assert [tuple(r)[:3] for r in scoring.usable_joins(df).collect()] == [(1, 2, 7.0)]


EDGES = [(0, 0, 1, "ACGTT"), (5, 0, 1, "TGCA"), (1, 0, 1, None), (2, 1, 2, "CGTA"), (3, 1, 2, None), (4, 2, 3, "GTCA"), (6, 2, 3, "TGCA")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(1, *e) for e in EDGES], "graph_id long, edge_id int, src int, dst int, label string")


def test_paths(spark, edges):
    ends = spark.createDataFrame([(1, 0, 3)], "graph_id long, start_node int, end_node int")
    got = G.all_paths(edges, ends).collect()
    assert sorted(len(r.path) for r in got) == [1] * 2 + [2] * 6 + [3] * 4
    assert {r.text for r in got} == set("ACGTTCGTAGTCA ACGTTCGTATGCA ACGTTGTCA ACGTTTGCA TGCACGTAGTCA TGCACGTATGCA TGCAGTCA TGCATGCA CGTAGTCA CGTATGCA GTCA TGCA".split())
    loop = G.add_rows(edges, spark.createDataFrame([(1, 9, 3, 0, "A"), (1, 10, 2, 1, "C")], edges.schema))
    assert G.all_paths(loop, ends).count() == 12
    assert G.all_paths(edges, ends.limit(0)).count() == 0


def test_matching_edges(spark, edges):
    for down, root, want in ((True, 0, {"A": (0, 0), "T": (5, 0), "C": (2, 0), "G": (4, 0)}), (False, 2, {"G": None, "T": (0, 4), "C": None, "A": (2, 3)})):
        roots = spark.createDataFrame([(1, root, c) for c in "ACGT"], "graph_id long, root long, symbol string")
        got = {r.symbol: (r.edge_id, r.off) if r.found else None for r in G.matching_edges(edges, roots, down).collect()}
        assert got == want


def test_cursors(spark):
    edges = spark.createDataFrame([(1, 0, 1, 2, "ACGT")], "graph_id long, edge_id int, src int, dst int, label string")
    for node, down, steps, want in ((1, True, [4], ["ACGT"]), (1, True, [2, 2], ["AC", "GT"]), (2, False, [4], ["TGCA"]), (2, False, [2, 2], ["TG", "CA"])):
        cursor = G.cursors_at(edges, spark.createDataFrame([(1, node)], "graph_id long, node_id int"), down)
        texts = []
        for n in steps:
            moved = G.consumed(cursor, edges, n, down)
            texts.append(moved.first()["text"])
            cursor = moved.drop("text")
        end = cursor.first()
        assert texts == want and (end.node_id, end.edge_id, end.off) == (3 - node, None, None)
    assert G.consumed(G.cursors_at(edges, spark.createDataFrame([(1, 1)], "graph_id long, node_id int")), edges, 5).first()["text"] is None


def test_match_length_and_equality(spark):
    for a, b, down, n in (("ACGT", "ACGT", True, 4), ("ACGT", "ACGT", False, 4), ("AGCT", "ACGT", False, 1), ("ACGC", "ACGT", True, 3), ("ACGT", "CCGT", True, 0), ("ACGA", "ACGT", False, 0)):
        x, y = F.lit(a), F.lit(b)
        column = G.match_length(x, F.lit(0), y, F.lit(0)) if down else G.match_length(x, F.length(x) - 1, y, F.length(y) - 1, down=False)
        assert spark.range(1).select(column).first()[0] == n
    schema = "a struct<graph_id: long, node_id: int, edge_id: int, off: int>, b struct<graph_id: long, node_id: int, edge_id: int, off: int>"
    rows = [((1, 2, None, None), (1, 2, None, None)), ((1, 2, 3, 0), (1, 2, 3, 0)), ((1, 2, 3, 0), (1, 2, 3, 1)), ((1, 2, None, 0), (2, 2, None, 0)), ((1, 2, 3, 0), (1, 2, None, None))]
    assert [r[0] for r in spark.createDataFrame(rows, schema).select(G.same_cursor("a", "b")).collect()] == [True, True, False, False, False]


def test_dot(spark):
    chain = spark.createDataFrame([(1, i, i, i + 1, "ACGT") for i in range(1, 4)], "graph_id long, edge_id int, src int, dst int, label string")
    cursor = spark.createDataFrame([(1, 1, 1, 0), (2, None, None, None)], "graph_id long, node_id int, edge_id int, off int")
    got = {r.graph_id: r.dot for r in G.dot(chain, cursor, 2).collect()}
    assert got[2] == "digraph {\n}"
    lines = got[1].split("\n")
    assert lines[1:4] == ['  N1 [label="N1" color=red];', '  N2 [label="N2"];', '  N3 [label="N3"];'] and '  N4 [label="N4..."];' in lines
    assert '  N1 -> N2 [label="E1[4]" color=red];' in lines and '  N2 -> N3 [label="E2[4]"];' in lines and len(lines) == 8


def test_training(spark):
    df = spark.createDataFrame([(2.0, 1), (4.0, 2), (6.0, 3)], "v double, k int")
    assert [r.v for r in training.min_max_scaled(df, "v").orderBy("k").collect()] == [0, 0.5, 1]
    both = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0)], "x double, y double")
    assert [tuple(r) for r in training.min_max_scaled(both, "x", "y").orderBy("x").collect()] == [(0.0, 0.5), (0.25, 1.0)]
    assert [r.v for r in training.min_max_scaled(df.where("k = 1"), "v").collect()] == [None]
    split = training.first_share(spark.range(10), ["id"])
    assert {r.id for r in split.where("train").collect()} == set(range(8))
    t = training.triplets(spark.range(200), "id").collect()
    assert all(len(r.anchor) == len(r.positive) == len(r.negative) == 24 and r.positive != r.negative and -4 <= r.phase <= 3 for r in t) and len(t) > 190
    assert training.triplets(spark.range(200), "id").exceptAll(training.triplets(spark.range(200), "id")).count() == 0
    m = training.ranking_match(spark.createDataFrame([(2, 1, 0.9, 0.5), (1, 2, 0.9, 0.5), (1, 1, 0.5, 0.5), (2, 1, 0.5, 0.5), (2, 1, 0.5, 0.7)], "score_ap int, score_an int, near_ap double, near_an double")).first()
    assert (m.triples, m.matches, m.errors) == (4, 1, 1) and m.mean_error == pytest.approx(0.2)
    h = {r.bin: r.n for r in training.histogram(spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "v double"), F.col("v"), 0.0, 1.0, 4).collect()}
    assert h == {1: 1, 3: 1, 4: 1}
    pairs = spark.createDataFrame([(1, "ACGTTACGGT", "ACGTACGGT"), (2, None, "A")], "id int, a string, b string")
    assert {r.id: r.concordance for r in training.with_concordance(pairs, "a", "b", 10).collect()} == {1: 0.9, 2: 0.0}
    for shuffled in (False, True):
        sizes = training.batches_of(spark.range(100).repartition(2), 16, shuffled).groupBy("batch").count().collect()
        assert sum(r["count"] for r in sizes) == 100 and max(r["count"] for r in sizes) == 16
