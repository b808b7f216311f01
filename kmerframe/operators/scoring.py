"""From candidate k-mers to ranked join candidates between subgraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerframe.functions.alignment import with_scores
from kmerframe.runtime import cut


def canonical_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(lo, hi): each unordered pair once."""
    return pairs.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def alignments(candidates: DataFrame, kmers: DataFrame) -> DataFrame:
    """(lo, hi, score) for candidates(a, b) of k-mers(id, kmer): canonical and distinct first, then one alignment for each pair."""
    pairs = canonical_pairs(candidates, "a", "b")
    texts = pairs.join(kmers.select(F.col("id").alias("lo"), F.col("kmer").alias("ta")), "lo").join(kmers.select(F.col("id").alias("hi"), F.col("kmer").alias("tb")), "hi")
    return with_scores(texts.select("lo", "hi", "ta", "tb"), "ta", "tb").select("lo", "hi", "score")


def place_counts(places: DataFrame) -> DataFrame:
    """(graph_id, id, n): how often each graph holds a k-mer, of places(graph_id, id)."""
    return places.groupBy("graph_id", "id").agg(F.count("*").alias("n"))


def subgraph_sums(counted: DataFrame, candidates: DataFrame, scored: DataFrame, home: DataFrame) -> DataFrame:
    """(graph_id, target, total): alignment scores of the k-mers of a graph, summed by the graph of the neighbour.

    counted as from place_counts, so a k-mer that is in very many places multiplies its score and no rows. candidates(a, b);
    scored(lo, hi, score); home(id, graph_id): the graph of a k-mer's representative.
    """
    near = candidates.select("a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).join(scored, ["lo", "hi"])
    return (
        counted.join(near, F.col("id") == F.col("a")).select("graph_id", F.col("b").alias("id"), (F.col("n") * F.col("score")).alias("points"))
        .join(home.select("id", F.col("graph_id").alias("target")), "id")
        .groupBy("graph_id", "target").agg(F.sum("points").alias("total"))
    )


def best_targets(sums: DataFrame, counts: DataFrame, itself: bool = False) -> DataFrame:
    """(graph_id, target, total, n, norm_score): the target of the largest sum, the smallest of equals, over the number of k-mers
    counts(graph_id, n) that had candidates. Without a positive sum target and norm_score are null. itself: a graph may choose itself."""
    sums = sums if itself else sums.where("target <> graph_id")
    best = sums.where("total > 0").groupBy("graph_id").agg(F.max(F.struct("total", (-F.col("target")).alias("t"))).alias("m"))
    return counts.join(best, "graph_id", "left").select("graph_id", (-F.col("m.t")).alias("target"), F.col("m.total").alias("total"), "n", F.try_divide("m.total", "n").alias("norm_score"))


def join_queue(best: DataFrame, threshold: float = 200.0) -> DataFrame:
    """(gd_lo, gd_hi, norm_score) of at least threshold, each pair once with its best score, in order: best first, then by ids."""
    kept = best.where(F.col("norm_score") >= threshold).select(F.least("graph_id", "target").alias("gd_lo"), F.greatest("graph_id", "target").alias("gd_hi"), "norm_score")
    return kept.groupBy("gd_lo", "gd_hi").agg(F.max("norm_score").alias("norm_score")).orderBy(F.desc("norm_score"), "gd_lo", "gd_hi")


def usable_joins(joins: DataFrame) -> DataFrame:
    """(gd_lo, gd_hi, norm_score, scored_at): the last score of each pair of different graphs, canonical, null and NaN left out.

    Of several scores of one time the largest counts. Combined before the shuffle.
    """
    good = "gd_lo IS NOT NULL AND gd_hi IS NOT NULL AND gd_lo <> gd_hi AND norm_score IS NOT NULL AND NOT isnan(norm_score)"
    return (
        joins.where(good).groupBy(F.least("gd_lo", "gd_hi").alias("gd_lo"), F.greatest("gd_lo", "gd_hi").alias("gd_hi"))
        .agg(F.max(F.struct("scored_at", "norm_score")).alias("m")).select("gd_lo", "gd_hi", "m.norm_score", "m.scored_at")
    )


def both_ends(joins: DataFrame) -> DataFrame:
    """(graph_id, partner, norm_score): each pair from either side, from one pass over joins."""
    sides = F.array(F.struct(F.col("gd_lo").alias("graph_id"), F.col("gd_hi").alias("partner")), F.struct(F.col("gd_hi").alias("graph_id"), F.col("gd_lo").alias("partner")))
    return joins.select("norm_score", F.inline(sides)).select("graph_id", "partner", "norm_score")


def ranked_partners(joins: DataFrame, threshold: float, top: int) -> DataFrame:
    """(graph_id, partner, norm_score, rank): the best partners of each graph, of either side, over a threshold."""
    both = both_ends(joins.where(F.col("norm_score") >= threshold))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("norm_score"), "partner"))).where(F.col("rank") <= top)


#: Pairs that one task may take in order, at most, when rounds accept less than a THIN-th of what is left.
LAST_ROWS, THIN = 200_000, 16


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (gd_lo, gd_hi, ...) of which neither graph was in an accepted pair before."""
    taken: set[int] = set()
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(a not in taken and b not in taken)
            if keep[-1]:
                taken.update((a, b))
        yield batch.filter(pa.array(keep, pa.bool_()))


def greedy_matching(joins: DataFrame) -> DataFrame:
    """(gd_lo, gd_hi, norm_score): what is accepted when pairs are taken best first (then by ids) and each graph once.

    Done in rounds, all graphs at once: a pair that is the best left for both its graphs is accepted, and all pairs of these
    graphs drop out. The result is that of the sequential order, as the order is total. Rounds end when no pair is left. A long chain of
    rising scores gives one pair a round; once a round accepts less than a THIN-th of what is left, and no more than LAST_ROWS pairs are
    left, these are taken in order by one task. More than that go on in rounds.
    """
    left = cut(joins.select("gd_lo", "gd_hi", "norm_score"))
    done: DataFrame | None = None
    order = F.struct("norm_score", (-F.col("gd_lo")).alias("x"), (-F.col("gd_hi")).alias("y"))
    while rows := left.count():
        ends = left.select(F.col("gd_lo").alias("g"), order.alias("o")).unionByName(left.select(F.col("gd_hi").alias("g"), order.alias("o")))
        tops = ends.groupBy("g").agg(F.max("o").alias("o"))
        agreed = tops.groupBy("o").agg(F.count("*").alias("n")).where("n = 2")
        accepted = cut(agreed.select((-F.col("o.x")).alias("gd_lo"), (-F.col("o.y")).alias("gd_hi"), F.col("o.norm_score").alias("norm_score")))
        done = accepted if done is None else done.unionByName(accepted)
        taken = accepted.select(F.col("gd_lo").alias("t")).unionByName(accepted.select(F.col("gd_hi").alias("t")))
        if rows <= LAST_ROWS and accepted.count() * THIN < rows:
            left = left.join(taken, F.col("gd_lo") == F.col("t"), "left_anti").join(taken, F.col("gd_hi") == F.col("t"), "left_anti")
            return done.unionByName(left.repartition(1).sortWithinPartitions(F.desc("norm_score"), "gd_lo", "gd_hi").mapInArrow(_in_order, left.schema))
        left = cut(left.join(taken, F.col("gd_lo") == F.col("t"), "left_anti").join(taken, F.col("gd_hi") == F.col("t"), "left_anti"))
    return left if done is None else done
