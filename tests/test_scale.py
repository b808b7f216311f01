"""What a query moves, on tables where moving too much shows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kmerframe.operators import embedding, reads, search
from kmerframe.plans import vectors


def shuffled(spark, run) -> int:
    """Rows written to shuffles by run()."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def written() -> int:
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    run()
    return written() - before


def test_rows_are_copied_once_for_thousands_of_queries(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(9000)], "id long, embedding array<float>").repartition(2).localCheckpoint()
    queries = rows.where("id % 3 = 0")
    got = {}
    moved = shuffled(spark, lambda: got.update({(r.query, r["rank"]): r.neighbour for r in search.exact_neighbours(queries, rows, 2).collect()}))
    # the rows, the queries once a block of rows (4), two neighbours a query and block, some counts
    assert len(got) == 6000 and moved < 9000 + 4 * 3000 + 4 * 2 * 3000 + 100
    x = np.array([r.embedding for r in rows.orderBy("id").collect()])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = np.round(x[::3] @ x.T, 12)
    near[np.arange(3000), np.arange(0, 9000, 3)] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, :2]
    assert got == {(3 * i, r + 1): int(best[i, r]) for i in range(3000) for r in range(2)}


def test_vectors_with_nan_are_nobodys_neighbours(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)] + [(7, [float("nan"), 1.0])], "id long, embedding array<float>")
    got = {(r.query, r.neighbour) for r in search.exact_neighbours(rows, rows, 9).collect()}
    assert got == {(i, j) for i in range(6) for j in range(6) if i != j}


def test_windows_without_query_are_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ACGT"), 600)) for _ in range(40)]
    spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "seq_id long, sequence string").write.parquet(str(tmp_path / "reads.parquet"))
    spark.createDataFrame([(i % 8, i) for i in range(40)], "graph_id long, seq_id long").write.parquet(str(tmp_path / "membership.parquet"))
    vectors = [(100 * i, 1, (i, 3), texts[i][3:19], rng.standard_normal(64).tolist(), None) for i in range(40)]
    fields = "vec_id long, config_id int, repr struct<seq_id: long, off: int>, kmer string, embedding array<float>, embedded_at timestamp"
    spark.createDataFrame(vectors, fields).write.parquet(str(tmp_path / "kmer_embeddings.parquet"))
    rows = []
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are too large for it
    try:
        moved = shuffled(spark, lambda: rows.extend(entry.queries()["subgraph_scores"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(r.n for r in rows) == 40
    assert moved < 40 * 584 / 2  # there are 40 * 584 windows


def test_windows_of_symbols_of_several_bytes(spark):
    texts = {1: "ACGTA", 2: "AÑGT日本", 3: "AC", 4: "", 5: "😀ABC"}
    df = spark.createDataFrame(list(texts.items()), "seq_id long, sequence string")
    got = {(r.seq_id, r.off, r.kmer) for r in reads.windows(df, 3).collect()}
    assert got == {(i, j, x[j : j + 3]) for i, x in texts.items() for j in range(len(x) - 2)}
    raw = reads.windows(df.where(F.col("seq_id") == 1), 3)
    assert dict(raw.dtypes) == {"seq_id": "bigint", "off": "int", "kmer": "string"}


def test_spectra_of_odd_texts():
    texts = ["ACGU", None, "", "A", "AANAA", "acGT", "TÑUT", "日AC", "GTGTG"]
    for q in (1, 2, 3):
        grams = embedding.SpectrumEmbedder(q).grams
        want = [[sum((x or "").replace("U", "T")[i : i + q] == g for i in range(len(x or ""))) for g in grams] for x in texts]
        assert embedding.spectra(pa.array(texts, pa.string()), q).tolist() == want
        assert embedding.spectra(pa.array(texts, pa.string()).slice(4, 3), q).tolist() == want[4:7]
    assert embedding.spectra(pa.array([None, ""], pa.string()), 2).sum() == 0


def test_spectrum_values_are_rounded_as_round_does(spark):
    values = np.concatenate([np.float32([1 / 32, 3 / 32, 0.5, 1.0, 0.00005, 0.00015]), np.random.default_rng(4).random(5000).astype(np.float32)])
    df = spark.createDataFrame([(str(i), [float(v)]) for i, v in enumerate(values)], "kmer string, embedding array<float>")
    want = {r.kmer: r.v for r in df.select("kmer", F.round(F.col("embedding")[0].cast("double"), 4).alias("v")).collect()}
    assert {r.kmer: r.value for r in vectors.spectrum_places(df).collect()} == want


def test_spectra_need_no_interpreted_lambdas(spark, tmp_path):
    """Lambdas over arrays are interpreted: 16 of them over 15 grams of a k-mer took most of the time of rna_spectrum."""
    spark.createDataFrame([(1, "ACGUACGUACGUACGUUA", "RNA")], "seq_id long, sequence string, seq_type string").write.parquet(str(tmp_path / "reads.parquet"))
    df = entry.queries()["rna_spectrum"](spark, str(tmp_path))
    assert len({r.kmer for r in df.collect()}) == 3
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
