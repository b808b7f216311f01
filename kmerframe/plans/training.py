"""Queries on training pairs and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerframe.functions.alignment import with_scores
from kmerframe.functions.sequences import contrastive_term, cosine
from kmerframe.operators import training as T
from kmerframe.plans.registry import query
from kmerframe.plans.sql import USABLE, dna, smith_waterman
from kmerframe.plans.sql import cosine as sql_cosine
from kmerframe.plans.vectors import kmer_pair_alignments, usable
from kmerframe.runtime import cut, table


@query("training_pairs", f"""
WITH RECURSIVE texts AS (SELECT p_partkey AS id, {dna("p_partkey")} AS a, {dna("'b' || p_partkey")} AS b FROM part), {smith_waterman("texts", 2, -3, 5, 2)},
bounds AS (SELECT min(score) AS lo, max(score) AS hi FROM sw)
SELECT id AS pair_id, a, b, score AS score_ab, round((score - lo) / (hi - lo), 6) AS scaled FROM texts JOIN sw USING (id), bounds
""")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cut(T.siamese_pairs(table(spark, sf_dir, "part"), "p_partkey"))
    return T.min_max_scaled(pairs.withColumn("scaled", F.col("score_ab").cast("double")), "scaled").withColumn("scaled", F.round("scaled", 6))


@query("alignment_concordance")
def alignment_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of equal symbols at the aligned places of each k-mer and the one of the next id."""
    k = table(spark, sf_dir, "kmer_embeddings").where("vec_id IS NOT NULL AND kmer IS NOT NULL").groupBy("vec_id").agg(F.min("kmer").alias("a"))
    pairs = k.join(k.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return T.with_concordance(pairs, "a", "b", 16).select("vec_id", "concordance")


@query("training_triplets")
def training_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.triplets(table(spark, sf_dir, "orders").select("o_orderkey").distinct(), "o_orderkey")


def _draw(n: int) -> str:
    return f"(('0x' || substr(md5(c_custkey::VARCHAR || '/{n}'), 1, 8))::BIGINT % 1048576)"


def _mutant(text: str, mutations: str, first: int) -> str:
    turn = f"((({list(T._STEPS)}[d{first} % 8 + 1] * (j - d{first + 1} % 24)) % 24 + 24) % 24)"
    letters = f"'{T.MUTATION_SYMBOLS}'"
    new = f"(instr({letters}, substr({text}, j + 1, 1)) - 1 + (d{first + 2} + 7 * {turn}) % 15 + 1) % 16"
    return f"array_to_string(list_transform(range(24), lambda j: CASE WHEN {turn} < {mutations} THEN substr({letters}, ({new} + 1)::INT, 1) ELSE substr({text}, (j + 1)::INT, 1) END), '')"


@query("training_triplets_scored", f"""
WITH RECURSIVE drawn AS (SELECT DISTINCT c_custkey AS pair_id, {dna("c_custkey")} || {dna("'p' || c_custkey")} AS parent, {", ".join(f"{_draw(n)} AS d{n}" for n in range(10))} FROM customer),
spec AS (SELECT *, (d0 % 8 - 4)::INT AS phase, d1 % 2 AS steps, (d2 % 10)::INT AS mutations, d3 % 2 AS more FROM drawn),
cuts AS (SELECT *, substr(parent, 17, 24) AS anchor, substr(parent, 17 + phase, 24) AS p, substr(parent, (17 + phase + CASE WHEN phase < 0 THEN -steps ELSE steps END)::INT, 24) AS n FROM spec WHERE steps > 0 OR more > 0),
trip AS (SELECT pair_id, phase, mutations, anchor, {_mutant("p", "mutations", 4)} AS positive, {_mutant("n", "(mutations + more)", 7)} AS negative FROM cuts),
texts AS (SELECT pair_id * 2 AS id, anchor AS a, positive AS b FROM trip UNION ALL SELECT pair_id * 2 + 1, anchor, negative FROM trip), {smith_waterman("texts", 2, -3, 5, 2, free="N-")},
kept AS (SELECT trip.*, x.score AS score_ap, y.score AS score_an FROM trip JOIN sw x ON x.id = pair_id * 2 JOIN sw y ON y.id = pair_id * 2 + 1 WHERE x.score <> y.score),
bounds AS (SELECT min(least(score_ap, score_an)) AS lo, max(greatest(score_ap, score_an)) AS hi FROM kept)
SELECT kept.*, round((score_ap - lo) / (hi - lo), 6) AS scaled_ap, round((score_an - lo) / (hi - lo), 6) AS scaled_an FROM kept, bounds
""")
def training_triplets_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets with both scores, rejection of equal ones, and joint scaling."""
    rows = T.scored_triplets(table(spark, sf_dir, "customer"), "c_custkey")
    return rows.withColumns({c: F.round(c, 6) for c in ("scaled_ap", "scaled_an")})


@query("train_test_split", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) <= floor((SELECT count(*) FROM customer) * 0.8) AS train FROM customer")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_share(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])


NEAR = f"{USABLE}, near AS (SELECT a.vec_id, {sql_cosine('a.e', 'b.e')} AS near FROM usable a JOIN usable b ON b.vec_id = a.vec_id + 1)"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.vector_pairs(usable(spark, sf_dir, "embedding").select("vec_id", "embedding")).select("vec_id", "near")


@query("similarity_histogram", f"""
WITH {NEAR}, r AS (SELECT round(near, 9) AS v FROM near)
SELECT least(floor((v + 1) / 0.05) + 1, 40)::INT AS bin, count(*) AS n FROM r WHERE v BETWEEN -1 AND 1 GROUP BY 1
""")
def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.histogram(_near(spark, sf_dir), F.round("near", 9), -1.0, 1.0, 40)


@query("contrastive_loss", f"""
WITH {NEAR}, y AS (SELECT near, (vec_id % 2)::DOUBLE AS y FROM near)
SELECT count(*) AS pairs, round(avg((1 - y) * near * near + y * power(greatest(0.25 - near, 0), 2)), 6) AS loss, round(min(near), 6) AS low, round(max(near), 6) AS high, round(avg(near), 6) AS mean FROM y
""")
def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _near(spark, sf_dir)
    loss = F.avg(contrastive_term((F.col("vec_id") % 2).cast("double"), F.col("near")))
    return rows.agg(F.count("*").alias("pairs"), F.round(loss, 6).alias("loss"), F.round(F.min("near"), 6).alias("low"), F.round(F.max("near"), 6).alias("high"), F.round(F.avg("near"), 6).alias("mean"))


_SCORES = f"""{NEAR}, k AS (SELECT vec_id, min(kmer) AS kmer FROM kmer_embeddings WHERE vec_id IS NOT NULL AND kmer IS NOT NULL GROUP BY vec_id),
texts AS (SELECT x.vec_id AS id, x.kmer AS a, y.kmer AS b FROM k x JOIN k y ON y.vec_id = x.vec_id + 1), {smith_waterman("texts", 5, -4, 3, 1)},
t AS (SELECT p.score AS ap, n.score AS an, round(x.near, 9) AS np, round(y.near, 9) AS nn FROM sw p JOIN sw n ON n.id = p.id + 1 JOIN near x ON x.vec_id = p.id JOIN near y ON y.vec_id = p.id + 1)"""


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of neighbouring ids beside the next one."""
    one = cut(kmer_pair_alignments(spark, sf_dir).join(_near(spark, sf_dir), "vec_id").withColumn("near", F.round("near", 9)))
    two = one.select((F.col("vec_id") - 1).alias("vec_id"), F.col("score").alias("score_an"), F.col("near").alias("near_an"))
    return one.join(two, "vec_id").select(F.col("score").alias("score_ap"), "score_an", F.col("near").alias("near_ap"), "near_an")


@query("ranking_match_rate", f"""
WITH RECURSIVE {_SCORES}
SELECT count(*) AS triples, sum((sign(ap - an) = sign(np - nn))::INT)::BIGINT AS matches, round(avg((sign(ap - an) = sign(np - nn))::INT), 6) AS match_rate,
  sum((ap > an AND nn > np)::INT)::BIGINT AS errors, round(avg(CASE WHEN ap > an AND nn > np THEN nn - np END), 6) AS mean_error FROM t WHERE ap <> an
""")
def ranking_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.ranking_match(_triples(spark, sf_dir))
    return r.select("triples", "matches", F.round("match_rate", 6).alias("match_rate"), "errors", F.round("mean_error", 6).alias("mean_error"))


@query("triplet_loss", f"""
WITH RECURSIVE {_SCORES}
SELECT round(avg(power(np - ap / 80, 2)) + avg(power(nn - an / 80, 2)) + max(greatest(nn - np + 0.1, 0)), 6) AS loss FROM t
""")
def triplet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against scores scaled by that of a 16-mer with itself, 80."""
    return _triples(spark, sf_dir).agg(F.round(T.triplet_loss(F.col("near_ap"), F.col("near_an"), F.col("score_ap") / 80, F.col("score_an") / 80), 6).alias("loss"))


_SAMPLED = f"""{USABLE}, k AS (SELECT vec_id, e, kmer FROM usable WHERE kmer IS NOT NULL),
mixed AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || '/s'), vec_id) - 1 AS n FROM k),
triples AS (SELECT n // 3 AS triple, max(CASE WHEN n % 3 = 0 THEN vec_id END) AS anchor, max(CASE WHEN n % 3 = 1 THEN vec_id END) AS positive, max(CASE WHEN n % 3 = 2 THEN vec_id END) AS negative FROM mixed GROUP BY n // 3 HAVING count(*) = 3)"""


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sampled_triples(usable(spark, sf_dir, "embedding").where("kmer IS NOT NULL"), "vec_id")


@query("sampled_triples", f"WITH {_SAMPLED} SELECT * FROM triples")
def sampled_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)


@query("evaluation_of_sampled_triples", f"""
WITH RECURSIVE {_SAMPLED},
texts AS (SELECT triple * 2 AS id, a.kmer AS a, p.kmer AS b FROM triples JOIN k a ON a.vec_id = anchor JOIN k p ON p.vec_id = positive UNION ALL SELECT triple * 2 + 1, a.kmer, n.kmer FROM triples JOIN k a ON a.vec_id = anchor JOIN k n ON n.vec_id = negative),
{smith_waterman("texts", 5, -4, 3, 1)},
t AS (SELECT x.score AS ap, y.score AS an, round({sql_cosine("a.e", "p.e")}, 9) AS np, round({sql_cosine("a.e", "n.e")}, 9) AS nn
  FROM triples JOIN sw x ON x.id = triple * 2 JOIN sw y ON y.id = triple * 2 + 1 JOIN k a ON a.vec_id = anchor JOIN k p ON p.vec_id = positive JOIN k n ON n.vec_id = negative)
SELECT count(*) AS triples, sum((sign(ap - an) = sign(np - nn))::INT)::BIGINT AS matches, round(avg((sign(ap - an) = sign(np - nn))::INT), 6) AS match_rate, sum((ap > an AND nn > np)::INT)::BIGINT AS errors,
  round(avg(CASE WHEN ap > an AND nn > np THEN nn - np END), 6) AS mean_error, round(avg(power(np - ap / 80, 2) + power(nn - an / 80, 2)), 6) AS loss FROM t WHERE ap <> an
""")
def evaluation_of_sampled_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation pass over random triples: ranking matches, errors, and the loss per row against scores scaled by 80."""
    rows = usable(spark, sf_dir, "embedding").where("kmer IS NOT NULL").select("vec_id", "kmer", "embedding")
    one = lambda name: rows.toDF(name, f"kmer_{name}", f"e_{name}")
    full = _sampled(spark, sf_dir).join(one("anchor"), "anchor").join(one("positive"), "positive").join(one("negative"), "negative")
    near = lambda other: F.round(cosine(F.col("e_anchor"), F.col(f"e_{other}")), 9)
    texts = full.select("kmer_anchor", "kmer_positive", "triple", "kmer_negative", near("positive").alias("near_ap"), near("negative").alias("near_an"))
    ap = with_scores(texts, "kmer_anchor", "kmer_positive").withColumnRenamed("score", "score_ap")
    both = cut(with_scores(ap.select("kmer_anchor", "kmer_negative", "triple", "near_ap", "near_an", "score_ap"), "kmer_anchor", "kmer_negative").withColumnRenamed("score", "score_an").where("score_ap <> score_an"))
    loss = both.agg(F.round(F.avg(F.pow(F.col("near_ap") - F.col("score_ap") / 80, 2) + F.pow(F.col("near_an") - F.col("score_an") / 80, 2)), 6).alias("loss"))
    told = T.ranking_match(both).select("triples", "matches", F.round("match_rate", 6).alias("match_rate"), "errors", F.round("mean_error", 6).alias("mean_error"))
    return told.crossJoin(F.broadcast(loss))  # one row each


@query("label_similarity", f"""
SELECT a.label, count(*) AS pairs, round(avg({sql_cosine("a.embedding", "b.embedding")}), 6) AS mean FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label
""")
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e"))
    return a.join(b, "vec_id").groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.avg(cosine(F.col("embedding"), F.col("e"))), 6).alias("mean"))
