"""Problem 7: mixing sources to target weights by capped water-filling.

Sizes are tokens of a public tokenizer. The total is shared out by target; a source that would need more than
max_repeats of its documents is clamped there, and what it lacks goes to the others in proportion to their targets, until
no source is over its cap. A source's share comes from whole repetitions of all its documents and a seeded part: the documents
with the smallest seeded hash, up to the hash below which the tokens still missing lie. That hash is found from two
histograms of fixed size, so no source, however large, is sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerframe.llm.tokens import DEFAULT_VOCABULARY, sized
from kmerframe.runtime import cut

#: Bits of each of the two histograms.
BITS = 12


def water_fill(total: float, shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """What each source gets of total: its share where the caps allow, the excess redistributed in proportion.

    Sources without a positive share or cap get 0. If all caps together are less than total, every source gets its cap.
    """
    got = {s: 0.0 for s in shares}
    free = {s for s in shares if shares[s] > 0 and caps.get(s, 0) > 0}
    left = float(total)
    while free and left > 0:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if left * shares[s] / weight >= caps[s]}
        if not full:
            got |= {s: left * shares[s] / weight for s in free}
            break
        got |= {s: float(caps[s]) for s in full}
        left -= sum(caps[s] for s in full)
        free -= full
    return got


def _targets(targets: DataFrame) -> DataFrame:
    good = F.col("source").isNotNull() & F.col("target_share").isNotNull() & ~F.isnan("target_share") & (F.col("target_share") > 0)
    return targets.where(good).groupBy("source").agg(F.max("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))


def _edge(histogram: list[tuple[int, int]], wanted: float) -> tuple[int, float]:
    """The bucket in which the running sum passes wanted, and what is still wanted of it."""
    for bucket, tokens in sorted(histogram):
        if wanted < tokens:
            return bucket, wanted
        wanted -= tokens
    return 1 << BITS, 0.0


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture(doc_id, source, tokens, copies): each document used, with how often, at least once and at most max_repeats times.
    report(source, target_share, max_repeats, documents, tokens, mixed_tokens, reached_share, repeats): a row for each source
    of targets; a source without documents reaches 0, which goes to the others. total is the size of the mixture in tokens,
    by default the tokens of all documents. Documents of other sources, of no source, or without tokens (null and empty texts)
    are not used. A repeated doc_id counts once; a null doc_id is left out. Targets that are null, NaN or not positive are
    left out, a null max_repeats is 1; of repeated targets the largest counts. No document, or no target, gives an empty mixture.
    """
    spark = documents.sparkSession
    wanted = {x["source"]: x for x in _targets(targets).collect()}  # one row per source named in the targets
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = (
        sized(documents.where(F.col("doc_id").isNotNull()), ["doc_id", "source"], vocabulary)
        .groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("d")).select("doc_id", "d.source", "d.tokens")
        .withColumn("high", F.shiftrightunsigned(place, 64 - BITS).cast("int"))
        .withColumn("low", F.shiftrightunsigned(place, 64 - 2 * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    )
    rows = cut(rows)
    if total is None:
        total = rows.agg(F.sum("tokens")).first()[0] or 0
    used = rows.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0))
    first: dict[str, list[tuple[int, int]]] = {s: [] for s in wanted}
    number = dict.fromkeys(wanted, 0)
    for x in used.groupBy("source", "high").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect():  # at most 2^BITS rows for a source
        first[x["source"]].append((x["high"], x["tokens"]))
        number[x["source"]] += x["n"]
    sizes = {s: sum(t for _, t in h) for s, h in first.items()}
    got = water_fill(total, {s: x["target_share"] for s, x in wanted.items()}, {s: sizes[s] * max(0, x["max_repeats"]) for s, x in wanted.items()})
    whole = {s: int(got[s] // sizes[s]) if sizes[s] else 0 for s in wanted}
    highs = {s: _edge(first[s], got[s] - whole[s] * sizes[s]) if whole[s] < wanted[s]["max_repeats"] else (-1, 0.0) for s in wanted}
    plan = spark.createDataFrame([(s, whole[s], highs[s][0]) for s in wanted], "source string, whole int, edge int")
    second: dict[str, list[tuple[int, int]]] = {s: [] for s in wanted}
    for x in used.join(plan, "source").where("high = edge").groupBy("source", "low").agg(F.sum("tokens").alias("tokens")).collect():
        second[x["source"]].append((x["low"], x["tokens"]))
    lows = {s: _edge(second[s], highs[s][1])[0] for s in wanted}
    plan = spark.createDataFrame([(s, whole[s], highs[s][0], lows[s]) for s in wanted], "source string, whole int, edge int, fine int")
    extra = F.when((F.col("high") < F.col("edge")) | ((F.col("high") == F.col("edge")) & (F.col("low") < F.col("fine"))), 1).otherwise(0)
    mixed = used.join(plan, "source").withColumn("copies", F.col("whole") + extra).where("copies > 0").select("doc_id", "source", "tokens", "copies")
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    base = spark.createDataFrame(
        [(s, float(x["target_share"]), int(x["max_repeats"]), number[s], int(sizes[s])) for s, x in wanted.items()],
        "source string, target_share double, max_repeats int, documents long, tokens long",
    )
    all_tokens = reached.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = (
        base.join(reached, "source", "left").crossJoin(F.broadcast(all_tokens))  # one row
        .select("source", "target_share", "max_repeats", "documents", "tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
                F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
                F.coalesce(F.try_divide("mixed_tokens", "tokens"), F.lit(0.0)).alias("repeats"))
    )
    return mixed, report
