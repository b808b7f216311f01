"""Sequence types, embedders, caches, representatives and training triplets on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerframe.config import AssemblerConfig, AssemblyState, SequenceType
from kmerframe.functions import alignment, alphabets
from kmerframe.operators import reads, training
from kmerframe.operators.embedding import CnnEmbedder, SpectrumEmbedder, forward, one_hot_rows
from kmerframe.plans.assembler import Assembler
from kmerframe.sources.cache import embedded_once, load_embeddings, made_once


def test_kinds_and_alphabets(spark):
    rows = [("ACGU", "RNA"), ("ACGT", " dna"), ("ACGU", "dna"), ("MKV", "aa"), ("MBV", "aa"), ("ACGT", None), ("", "rna"), (None, "rna"), ("ac-.", "DNA")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t string").withColumn("kind", alphabets.sequence_kind(F.col("t")))
    got = df.select("i", "kind", alphabets.known_symbols(F.col("s"), F.col("kind")).alias("n"), alphabets.typed_one_hot_positions(F.col("s"), F.col("kind")).alias("p")).orderBy("i").collect()
    assert [r.kind for r in got] == ["rna", "dna", "dna", "aa", "aa", "uninitialised", "rna", "rna", "dna"]
    assert [r.n for r in got] == [4, 4, 3, 3, 2, None, 0, None, 4]
    assert [r.p for r in got[:4]] == [[0, 1, 2, 3], [0, 1, 2, 3], [0, 1, 2, -1], None] and got[5].p == [0, 1, 2, 3] and got[8].p == [-1, -1, 15, 15]
    names = df.select(alphabets.name_of(F.lit("U"), F.col("kind")).alias("n"), alphabets.code_of(F.lit("U"), F.col("kind")).alias("c")).collect()
    assert [r.n for r in names[:4]] == ["Uracil", None, None, "Selenocysteine"] and names[3].c == "Sec" and names[5].n is None


def test_rna_has_the_spectrum_of_dna(spark):
    df = spark.createDataFrame([("ACGUUUGU",), ("ACGTTTGT",)], "kmer string")
    x, y = (r.embedding for r in SpectrumEmbedder(2)(df).collect())
    assert x == y and sum(v > 0 for v in x) == 5


def test_cnn(spark):
    model = CnnEmbedder(k=32, hidden=40, dim=12)
    kmers = ["".join(random.Random(i).choice("ACGT") for _ in range(32)) for i in range(20)]
    df = spark.createDataFrame([(k,) for k in [*kmers, "ACGT"]], "kmer string")
    got = {r.kmer: np.array(r.embedding) for r in model(df).collect()}
    assert set(got) == set(kmers) and all(len(v) == 12 and np.linalg.norm(v) == pytest.approx(1, abs=1e-5) for v in got.values())
    again = {r.kmer: np.array(r.embedding) for r in CnnEmbedder(k=32, hidden=40, dim=12)(df).collect()}
    assert all(np.allclose(got[k], again[k], atol=1e-6) for k in kmers) and not np.allclose(got[kmers[0]], got[kmers[1]])
    assert CnnEmbedder().weights()[-2].shape == (768, 8192) and CnnEmbedder().weights()[-1].shape == (8192, 512)
    # one convolution by hand
    rng = np.random.default_rng(1)
    w = [rng.standard_normal((48, 3)).astype(np.float32), rng.standard_normal((3, 4)).astype(np.float32), rng.standard_normal((4, 2)).astype(np.float32)]
    x = one_hot_rows(["ACGT"], "ACGTRYSWKMBDHVN", ".-")
    c = np.maximum(np.stack([x[0, i : i + 3].ravel() @ w[0] for i in range(2)]), 0).max(0)
    v = np.maximum(c @ w[1], 0) @ w[2]
    assert np.allclose(forward(x, w)[0], v / np.linalg.norm(v), atol=1e-5)
    with pytest.raises(ValueError):
        CnnEmbedder(k=8).weights()


def test_cache(spark, tmp_path):
    path, asked = str(tmp_path / "kept"), []

    def embed(df):
        asked.append(sorted(r.kmer for r in df.collect()))
        return SpectrumEmbedder(2)(df)

    none = spark.createDataFrame([], "kmer string")
    assert load_embeddings(spark, path, "m") is None and embedded_once(none, embed, path, "m").count() == 0
    df = spark.createDataFrame([("ACGT",), ("ACGT",), ("TTTT",)], "kmer string")
    assert {r.kmer for r in embedded_once(df, embed, path, "m").collect()} == {"ACGT", "TTTT"}
    more = df.unionByName(spark.createDataFrame([("GGGG",)], "kmer string"))
    assert embedded_once(more, embed, path, "m").count() == 3 and asked[-1] == ["GGGG"]
    assert embedded_once(none, embed, path, "m").count() == 0 and embedded_once(df, embed, path, "other").count() == 2
    assert made_once(spark, str(tmp_path / "made"), lambda: df).count() == 3 and made_once(spark, str(tmp_path / "made"), lambda: 1 / 0).count() == 3


def test_assembler_of_rna_with_cache(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(rng.choice("ACGU") for _ in range(60))
    config = AssemblerConfig(kmer_len=16, knn_top_k=4, subgraph_join_threshold=1.0)
    for _ in range(2):
        run = Assembler(spark, config, exact=True, cache=str(tmp_path / "cache"))
        run.start_reads([text, text[5:] + "ACGUA"], SequenceType.RNA)
        assert run.wait(120).state is AssemblyState.COMPLETE, run.status().error
        assert run.status().joins == 1
    kept = spark.read.parquet(str(tmp_path / "cache"))
    assert kept.count() == kept.select("kmer").distinct().count() == run.status().kmers


def test_representative_or_itself(spark):
    first = spark.createDataFrame([("AC", 5, 2, 3)], "kmer string, seq_id long, off int, multiplicity long")
    told = spark.createDataFrame([("AC", 9, 9, 1), ("GG", 7, 1, 2), (None, 4, 0, 3)], "kmer string, seq_id long, off int, id int")
    got = {r.id: (r.seq_id, r.off, r.found) for r in reads.represented(told, first).collect()}
    assert got == {1: (5, 2, True), 2: (7, 1, False), 3: (4, 0, False)}


def test_concordances_are_those_of_single_pairs():
    rng = random.Random(9)
    a = ["".join(rng.choice("ACGTNRa") for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    b = [x[3:9] + "GG" + x[9:] if i % 2 else "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 30))) for i, x in enumerate(a)]
    for matrix, opened, extended in ((alignment.NUC44, 3, 1), (alignment.simple_matrix(2, -3), 5, 2)):
        got = alignment.concordances(a, b, 16, matrix, opened, extended)
        want = [sum(x[i] == y[j] for i, j in alignment.traced(x, y, matrix, opened, extended)) / 16 for x, y in zip(a, b, strict=True)]
        assert got.tolist() == want
    assert alignment.concordances([], [], 16).tolist() == [] and alignment.concordances(["", "A"], ["A", ""], 16).tolist() == [0, 0]


def test_triplets(spark):
    df = training.scored_triplets(spark.range(400).unionByName(spark.range(3)), "id").collect()
    assert len({r.pair_id for r in df}) == len(df) > 200
    assert all(r.score_ap != r.score_an and 0 <= r.mutations <= 9 and -4 <= r.phase <= 3 and len(r.anchor) == len(r.positive) == len(r.negative) == 24 for r in df)
    scaled = [v for r in df for v in (r.scaled_ap, r.scaled_an)]
    assert min(scaled) == 0 and max(scaled) == 1
    assert {c for r in df for c in r.positive} > set("ACGT")
    still = [r for r in df if r.phase == 0]
    assert still and all(sum(x != y for x, y in zip(r.anchor, r.positive, strict=True)) == r.mutations for r in still)
    low, high = min(min(r.score_ap, r.score_an) for r in df), max(max(r.score_ap, r.score_an) for r in df)
    assert all(r.scaled_ap == pytest.approx((r.score_ap - low) / (high - low)) for r in df)


def test_sampled_triples(spark):
    for n in (0, 2, 3, 100):
        got = training.sampled_triples(spark.range(n), "id").collect()
        used = [v for r in got for v in (r.anchor, r.positive, r.negative)]
        assert len(got) == n // 3 and len(set(used)) == len(used)
