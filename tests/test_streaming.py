from kmerframe.sources.fasta import write_fasta
from kmerframe.streaming import kmers as K


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_counts_follow_new_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "name string, description string, data string"
    spark.createDataFrame([("a", None, "ACGTACGU")], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    got = drain(K.kmer_counts(stream, "data", 4), "counts", tmp_path, "complete")
    assert {r.kmer: r.n for r in got.collect()} == {"ACGT": 2, "CGTA": 1, "GTAC": 1, "TACG": 1}


def test_fasta_stream(spark, tmp_path):
    folder, schema = str(tmp_path / "fasta"), "name string, description string, data string"
    write_fasta(spark.createDataFrame([("a", None, "ACGT"), ("b", None, "GG")], schema).coalesce(1), folder)
    q = K.fasta_stream(spark, folder).writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert {r.name for r in spark.table("records").collect()} == {"a", "b"}
    write_fasta(spark.createDataFrame([("c", None, "TT")], schema).coalesce(1), folder)
    q.processAllAvailable()
    q.stop()
    assert sorted(r.name for r in spark.table("records").collect()) == ["a", "b", "c"]


def test_event_time(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = [("p", 1, "ACGT", "2024-01-01 00:00:10"), ("p", 1, "ACGT", "2024-01-01 00:00:20"), ("p", 2, "AC", "2024-01-01 00:01:10")]
    spark.createDataFrame(rows, "path string, ordinal long, data string, t string").selectExpr("path", "ordinal", "data", "cast(t as timestamp) t").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("path string, ordinal long, data string, t timestamp").parquet(folder)
    got = drain(K.records_by_time(stream, "t", "1 minute", "5 minutes"), "windows", tmp_path, "update")
    assert sorted((r.records, r.symbols) for r in got.collect()) == [(1, 2), (2, 8)]
    assert drain(K.first_seen(stream, ["path", "ordinal"], "t", "1 hour"), "first", tmp_path).count() == 2
