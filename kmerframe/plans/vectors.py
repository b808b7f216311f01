"""Queries on vectors: normalising, similarity, exact search, alignment of what was found, and subgraph scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerframe.functions import sequences as S
from kmerframe.functions.alignment import with_scores
from kmerframe.operators import scoring, search
from kmerframe.operators.embedding import SpectrumEmbedder
from kmerframe.operators.reads import windows
from kmerframe.plans.reads import reads_once
from kmerframe.plans.registry import query
from kmerframe.plans.sql import ONCE, USABLE, cosine, dot, smith_waterman
from kmerframe.runtime import cut, table

K = 6
EVERY = 100


def usable(spark: SparkSession, sf_dir: str, *rest: str) -> DataFrame:
    """(vec_id, config_id, kmer, repr, ...): usable vectors, each once, the one embedded first. rest: `embedding`, where it is needed;
    it is nearly all of a row, and is shuffled with it."""
    good = (F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    first = F.min(F.struct(F.col("embedded_at").isNull().alias("n"), "embedded_at", "config_id", "kmer", "repr", *rest)).alias("r")
    columns = ["config_id", "kmer", "repr", *rest]
    return table(spark, sf_dir, "kmer_embeddings").where(good).groupBy("vec_id").agg(first).select("vec_id", *[f"r.{c}" for c in columns])


@query("l2_normalised", f"SELECT vec_id, round(sqrt({dot('embedding', 'embedding')}), 6) AS size, round(embedding[1] / (sqrt({dot('embedding', 'embedding')}) + 1e-30), 6) AS first, round(embedding[64] / (sqrt({dot('embedding', 'embedding')}) + 1e-30), 6) AS last FROM embeddings")
def l2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.sqrt(S.dot(F.col("embedding"), F.col("embedding"))).alias("s"), S.normalised(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round("s", 6).alias("size"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("cosine_of_neighbouring_ids", f"""
WITH {USABLE} SELECT a.vec_id, round({cosine("a.e", "b.e")}, 6) AS near, round(1 - {dot("a.e", "b.e")}, 5) AS distance FROM usable a JOIN usable b ON b.vec_id = a.vec_id + 1
""")
def cosine_of_neighbouring_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = usable(spark, sf_dir, "embedding").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e"))
    return a.join(b, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("e")), 6).alias("near"), F.round(S.inner_product_distance(F.col("embedding"), F.col("e")), 5).alias("distance"))


_GRAMS = [a + b for a in "ACGT" for b in "ACGT"]
_COUNTS = ", ".join(f"len(list_filter(range(1, length(kmer)), lambda i: substr(kmer, i, 2) = '{g}'))" for g in _GRAMS)


def spectrum_places(embedded: DataFrame) -> DataFrame:
    """(kmer, gram, value): the non-zero places of spectra, to four decimals. For a float, 10,000 x + 0.5 is exact in double precision, so
    this is what round() gives, which goes through decimal text."""
    places = embedded.select("kmer", F.posexplode("embedding").alias("gram", "value")).where("value > 0")
    return places.select("kmer", F.col("gram").cast("long").alias("gram"), (F.floor(F.col("value").cast("double") * 10_000 + 0.5) / 10_000).alias("value"))


@query("spectrum_embedding", f"""
WITH k AS (SELECT DISTINCT kmer FROM kmer_embeddings WHERE kmer IS NOT NULL), c AS (SELECT kmer, [{_COUNTS}]::DOUBLE[] AS v FROM k)
SELECT kmer, i AS gram, round(v[i + 1] / sqrt(list_dot_product(v, v)), 4) AS value FROM c, range(16) r(i) WHERE v[i + 1] > 0
""")
def spectrum_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero places of the 2-gram spectrum of each distinct k-mer."""
    kmers = table(spark, sf_dir, "kmer_embeddings").select("kmer").where("kmer IS NOT NULL").distinct()
    return spectrum_places(SpectrumEmbedder(2)(kmers))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, neighbour, cosine, rank): the K nearest of each query vector (ids divisible by EVERY), against all of its configuration."""
    rows = usable(spark, sf_dir, "embedding").select(F.col("vec_id").alias("id"), "config_id", "embedding")
    return search.exact_neighbours(rows.where(F.col("id") % EVERY == 0), rows, K, "config_id")


FOUND = f"""{USABLE}, sims AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, {cosine("q.e", "r.e")} AS c FROM usable q JOIN usable r ON q.config_id = r.config_id AND q.vec_id <> r.vec_id WHERE q.vec_id % {EVERY} = 0),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 12) DESC, neighbour) AS rank FROM sims) WHERE rank <= {K})"""


@query("knn_topk", f"WITH {FOUND} SELECT query, neighbour, round(c, 6) AS near, rank FROM found")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("query", "neighbour", F.round("cosine", 6).alias("near"), "rank")


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(config_id, k): knn_top_k of each configuration."""
    return table(spark, sf_dir, "assembler_config").where("config_id IS NOT NULL AND knn_top_k IS NOT NULL").groupBy("config_id").agg(F.max("knn_top_k").alias("k"))


def found_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As found, with knn_top_k of the configuration in place of K."""
    rows = usable(spark, sf_dir, "embedding").select(F.col("vec_id").alias("id"), "config_id", "embedding").join(top_k(spark, sf_dir), "config_id")
    most = rows.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    near = search.exact_neighbours(rows.where(F.col("id") % EVERY == 0).drop("k"), rows.drop("k"), most, "config_id")
    return near.join(rows.select(F.col("id").alias("query"), "k"), "query").where("rank <= k").drop("k")


FOUND_CONFIGURED = f"""{USABLE}, top_k AS (SELECT config_id, max(knn_top_k) AS k FROM assembler_config WHERE knn_top_k IS NOT NULL GROUP BY config_id),
sims AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, k, {cosine("q.e", "r.e")} AS c FROM usable q JOIN usable r ON q.config_id = r.config_id AND q.vec_id <> r.vec_id JOIN top_k ON top_k.config_id = q.config_id WHERE q.vec_id % {EVERY} = 0),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 12) DESC, neighbour) AS rank FROM sims) WHERE rank <= k)"""


@query("knn_topk_configured", f"WITH {FOUND_CONFIGURED} SELECT query, neighbour, round(c, 6) AS near, rank FROM found")
def knn_topk_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_configured(spark, sf_dir).select("query", "neighbour", F.round("cosine", 6).alias("near"), "rank")


@query("knn_label_purity", f"""
WITH s AS (SELECT q.vec_id AS query, q.label AS ql, r.label AS rl, r.vec_id AS neighbour, {cosine("q.embedding", "r.embedding")} AS c FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % {EVERY} = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 12) DESC, neighbour) AS rank FROM s)
SELECT ql AS label, count(*) AS neighbours, sum((ql = rl)::INT)::BIGINT AS same FROM t WHERE rank <= {K} GROUP BY ql
""")
def knn_label_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    near = search.exact_neighbours(rows.where(F.col("id") % EVERY == 0).select("id", "embedding"), rows.select("id", "embedding"), K)
    a, b = rows.select(F.col("id").alias("query"), "label"), rows.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
    return near.join(a, "query").join(b, "neighbour").groupBy("label").agg(F.count("*").alias("neighbours"), F.count_if(F.col("label") == F.col("other")).alias("same"))


def alignments_of(spark: SparkSession, sf_dir: str, near: DataFrame) -> DataFrame:
    kmers = usable(spark, sf_dir).select(F.col("vec_id").alias("id"), "kmer")
    return scoring.alignments(near.select(F.col("query").alias("a"), F.col("neighbour").alias("b")), kmers)


ALIGNED = f"""{FOUND}, pairs AS (SELECT DISTINCT least(query, neighbour) AS lo, greatest(query, neighbour) AS hi FROM found),
texts AS (SELECT lo || '/' || hi AS id, x.kmer AS a, y.kmer AS b FROM pairs JOIN usable x ON x.vec_id = lo JOIN usable y ON y.vec_id = hi),
{smith_waterman("texts", 5, -4, 3, 1)},
aligned AS (SELECT lo, hi, score FROM pairs JOIN sw ON id = lo || '/' || hi)"""


@query("knn_alignments", f"WITH RECURSIVE {ALIGNED} SELECT lo, hi, score FROM aligned")
def knn_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments_of(spark, sf_dir, found(spark, sf_dir))


@query("knn_alignments_configured", f"WITH RECURSIVE {ALIGNED.replace(FOUND, FOUND_CONFIGURED)} SELECT lo, hi, score FROM aligned")
def knn_alignments_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments_of(spark, sf_dir, found_configured(spark, sf_dir))


@query("subgraph_scores", f"""
WITH RECURSIVE {ONCE}, {ALIGNED},
member AS (SELECT seq_id, min(graph_id) AS graph_id FROM membership WHERE graph_id IS NOT NULL AND seq_id IS NOT NULL GROUP BY seq_id),
w AS (SELECT seq_id, substr(sequence, i + 1, 16) AS kmer FROM once, LATERAL (SELECT unnest(range(0, length(sequence) - 16)) AS i)),
queries AS (SELECT DISTINCT query AS id, kmer FROM found JOIN usable ON vec_id = query),
places AS (SELECT graph_id, id, count(*) AS n FROM w JOIN queries USING (kmer) JOIN member USING (seq_id) GROUP BY graph_id, id),
home AS (SELECT vec_id AS id, graph_id AS target FROM usable JOIN member ON member.seq_id = usable.repr.seq_id),
sums AS (SELECT p.graph_id, target, sum(n * score)::BIGINT AS total FROM places p JOIN found f ON f.query = p.id JOIN aligned a ON a.lo = least(query, neighbour) AND a.hi = greatest(query, neighbour) JOIN home h ON h.id = neighbour GROUP BY p.graph_id, target),
counts AS (SELECT graph_id, sum(n)::BIGINT AS n FROM places GROUP BY graph_id),
best AS (SELECT graph_id, target, total, row_number() OVER (PARTITION BY graph_id ORDER BY total DESC, target) AS r FROM sums WHERE target <> graph_id AND total > 0)
SELECT c.graph_id, target, total, n, round(total / n, 6) AS norm_score FROM counts c LEFT JOIN best b ON b.graph_id = c.graph_id AND r = 1
""")
def subgraph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each graph that holds query k-mers: the graph that their neighbours point at. The last window of a read isn't scored."""
    return scores_of(spark, sf_dir, found(spark, sf_dir))


@query("subgraph_scores_whole")
def subgraph_scores_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each graph that holds embedded k-mers: the graph that their neighbours point at, over all usable vectors, with knn_top_k
    of each configuration. Exact; no SQL, as all pairs of vectors are too many for it on larger tables."""
    rows = usable(spark, sf_dir, "embedding").join(top_k(spark, sf_dir), "config_id").select(F.col("vec_id").alias("id"), F.col("config_id").alias("grp"), "k", "embedding")
    return scores_of(spark, sf_dir, search.all_neighbours(cut(rows)))


#: Buckets of the sieve that windows pass before the join with k-mers: what is broadcast is a number per bucket at most.
SIEVE = 1 << 22


def scores_of(spark: SparkSession, sf_dir: str, near: DataFrame) -> DataFrame:
    """(graph_id, target, total, n, norm_score) over the candidates near(query, neighbour). Windows that can't be k-mers of
    queries are left out before the shuffle."""
    vectors = cut(usable(spark, sf_dir))
    near = cut(near.select("query", "neighbour"))
    member = table(spark, sf_dir, "membership").where("graph_id IS NOT NULL AND seq_id IS NOT NULL").groupBy("seq_id").agg(F.min("graph_id").alias("graph_id"))
    queries = near.select(F.col("query").alias("vec_id")).distinct().join(vectors, "vec_id").select(F.col("vec_id").alias("id"), "kmer")
    reads = reads_once(spark, sf_dir).select("seq_id", F.expr("substr(sequence, 1, greatest(0, length(sequence) - 1))").alias("sequence"))
    bucket = F.pmod(F.xxhash64("kmer"), F.lit(SIEVE)).alias("bucket")
    sieved = windows(reads, 16).select("*", bucket).join(F.broadcast(queries.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    places = sieved.join(queries, "kmer").join(member, "seq_id").select("graph_id", "id")
    places = cut(scoring.place_counts(places))
    home = vectors.select(F.col("vec_id").alias("id"), F.col("repr.seq_id").alias("seq_id")).join(member, "seq_id").select("id", "graph_id")
    candidates = near.select(F.col("query").alias("a"), F.col("neighbour").alias("b"))
    scored = scoring.alignments(candidates, vectors.select(F.col("vec_id").alias("id"), "kmer"))
    sums = scoring.subgraph_sums(places, candidates, scored, home)
    counts = places.groupBy("graph_id").agg(F.sum("n").alias("n"))
    return scoring.best_targets(sums, counts).withColumn("norm_score", F.round("norm_score", 6))


@query("kmer_pair_alignments", f"""
WITH RECURSIVE k AS (SELECT vec_id, min(kmer) AS kmer FROM kmer_embeddings WHERE vec_id IS NOT NULL AND kmer IS NOT NULL GROUP BY vec_id),
texts AS (SELECT x.vec_id AS id, x.kmer AS a, y.kmer AS b FROM k x JOIN k y ON y.vec_id = x.vec_id + 1), {smith_waterman("texts", 5, -4, 3, 1)}
SELECT id AS vec_id, score FROM sw
""")
def kmer_pair_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment score of each k-mer with that of the next id."""
    k = table(spark, sf_dir, "kmer_embeddings").where("vec_id IS NOT NULL AND kmer IS NOT NULL").groupBy("vec_id").agg(F.min("kmer").alias("a"))
    pairs = k.join(k.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return with_scores(pairs, "a", "b").select("vec_id", "score")
