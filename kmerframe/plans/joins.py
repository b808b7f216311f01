"""Queries on scored pairs of graphs: canonical pairs, candidates, ranking, matching, and alignment of whole paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerframe.functions.alignment import with_scores
from kmerframe.operators import graphs, scoring
from kmerframe.plans.reads import reads_once
from kmerframe.plans.registry import query
from kmerframe.runtime import table

THRESHOLD = 200.0
TOP = 5

#: The last score of each pair of different graphs.
PAIRS = """pairs AS (
  SELECT a AS gd_lo, b AS gd_hi, norm_score FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY scored_at DESC NULLS LAST, norm_score DESC) AS r FROM (
      SELECT least(gd_lo, gd_hi) AS a, greatest(gd_lo, gd_hi) AS b, norm_score, scored_at FROM potential_joins
      WHERE gd_lo IS NOT NULL AND gd_hi IS NOT NULL AND gd_lo <> gd_hi AND norm_score IS NOT NULL AND NOT isnan(norm_score)))
  WHERE r = 1)"""


def _joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.usable_joins(table(spark, sf_dir, "potential_joins"))


@query("canonical_graph_pairs", "SELECT DISTINCT least(gd_lo, gd_hi) AS lo, greatest(gd_lo, gd_hi) AS hi FROM potential_joins WHERE gd_lo IS NOT NULL AND gd_hi IS NOT NULL")
def canonical_graph_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.canonical_pairs(table(spark, sf_dir, "potential_joins").where("gd_lo IS NOT NULL AND gd_hi IS NOT NULL"), "gd_lo", "gd_hi")


@query("subgraph_candidates", f"""
WITH {PAIRS}, ends AS (SELECT gd_lo AS graph_id, gd_hi AS partner, norm_score FROM pairs WHERE norm_score >= {THRESHOLD} UNION ALL SELECT gd_hi, gd_lo, norm_score FROM pairs WHERE norm_score >= {THRESHOLD})
SELECT * FROM (SELECT graph_id, partner, norm_score, row_number() OVER (PARTITION BY graph_id ORDER BY norm_score DESC, partner) AS rank FROM ends) WHERE rank <= {TOP}
""")
def subgraph_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ranked_partners(_joins(spark, sf_dir), THRESHOLD, TOP)


@query("join_queue", f"WITH {PAIRS} SELECT gd_lo, gd_hi, norm_score FROM pairs WHERE norm_score >= {THRESHOLD} ORDER BY norm_score DESC, gd_lo, gd_hi")
def join_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joins(spark, sf_dir).where(F.col("norm_score") >= THRESHOLD).select("gd_lo", "gd_hi", "norm_score").orderBy(F.desc("norm_score"), "gd_lo", "gd_hi")


@query("graph_pair_totals", f"""
WITH {PAIRS}, ends AS (SELECT gd_lo AS graph_id, norm_score FROM pairs UNION ALL SELECT gd_hi, norm_score FROM pairs)
SELECT graph_id, count(*) AS pairs, round(min(norm_score), 4) AS low, round(max(norm_score), 4) AS high, sum(round(norm_score * 10000)::BIGINT)::BIGINT AS points FROM ends GROUP BY graph_id
""")
def graph_pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = scoring.both_ends(_joins(spark, sf_dir))
    value = lambda f: F.round(f("norm_score"), 4)
    return ends.groupBy("graph_id").agg(F.count("*").alias("pairs"), value(F.min).alias("low"), value(F.max).alias("high"), F.sum(F.round(F.col("norm_score") * 10000).cast("long")).alias("points"))


@query("best_first_matching", f"""
WITH RECURSIVE {PAIRS}, queue AS (SELECT gd_lo, gd_hi, norm_score, row_number() OVER (ORDER BY norm_score DESC, gd_lo, gd_hi) AS r FROM pairs WHERE norm_score >= {THRESHOLD}),
walk AS (
  SELECT 0::BIGINT AS r, []::BIGINT[] AS taken, false AS fits
  UNION ALL
  SELECT r, CASE WHEN fits THEN taken || [gd_lo, gd_hi] ELSE taken END, fits
  FROM (SELECT q.r, gd_lo, gd_hi, taken, NOT list_contains(taken, gd_lo) AND NOT list_contains(taken, gd_hi) AS fits FROM walk JOIN queue q ON q.r = walk.r + 1))
SELECT gd_lo, gd_hi, norm_score FROM walk JOIN queue USING (r) WHERE fits
""")
def best_first_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.greedy_matching(_joins(spark, sf_dir).where(F.col("norm_score") >= THRESHOLD))


@query("join_path_pair_scores")
def join_path_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of paths of two graphs that are to be joined, aligned. The graphs carry one read each."""
    _, _, edges = graphs.read_graphs(reads_once(spark, sf_dir), table(spark, sf_dir, "membership"))
    paths = edges.where("label <> ''").select("graph_id", F.col("edge_id").alias("path_id"), F.col("label").alias("text"))
    pairs = _joins(spark, sf_dir).where(F.col("norm_score") >= THRESHOLD).select("gd_lo", "gd_hi")
    both = (
        pairs.join(paths.toDF("gd_lo", "path_lo", "ta"), "gd_lo").join(paths.toDF("gd_hi", "path_hi", "tb"), "gd_hi")
        .select("gd_lo", "path_lo", "gd_hi", "path_hi", "ta", "tb")
    )
    return with_scores(both, "ta", "tb").select("gd_lo", "path_lo", "gd_hi", "path_hi", "score")
