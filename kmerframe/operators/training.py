"""Training pairs for an embedding network, their scaling and splitting, and the metrics of an evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerframe.functions.alignment import concordances, simple_matrix, with_scores
from kmerframe.functions.sequences import cosine, dna_of_key, mutated
from kmerframe.operators.reads import numbered
from kmerframe.runtime import cut, over_all_cores

#: Labels come from match 2, mismatch -3, N 0, gaps of 5 and 2.
LABEL_MATRIX, LABEL_OPENED, LABEL_EXTENDED = simple_matrix(2, -3), 5, 2


def with_concordance(pairs: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """pairs with `concordance`: equal symbols at the aligned places of a best local alignment, per k. All pairs of a block are aligned
    and traced together; a null text counts as empty."""
    rows = over_all_cores(pairs, *([c for c in pairs.columns if c not in (a, b)] or [a, b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            yield pa.record_batch([*batch.columns, pa.array(concordances([p or "" for p in x], [q or "" for q in y], k))], names=[*batch.schema.names, "concordance"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields + ", concordance double")


def batches_of(df: DataFrame, size: int, shuffled: bool = False, seed: int = 0) -> DataFrame:
    """df with `batch`: rows in batches of `size` for a loader, in the order of partitions or in a seeded order. Batches never
    reach over partitions, so the last one of each partition may be smaller."""
    rows = df.sortWithinPartitions(F.xxhash64(F.lit(seed), *df.columns)) if shuffled else df
    place = F.monotonically_increasing_id()
    part, at = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("batch", F.struct(part.cast("int").alias("part"), F.floor(at / size).cast("long").alias("number")))


def siamese_pairs(keys: DataFrame, key: str) -> DataFrame:
    """(pair_id, a, b, score_ab): two independent sequences for each key, and their alignment score."""
    pairs = keys.select(F.col(key).alias("pair_id")).select("pair_id", dna_of_key(F.col("pair_id")).alias("a"), dna_of_key(F.concat(F.lit("b"), F.col("pair_id").cast("string"))).alias("b"))
    return with_scores(pairs.select("a", "b", "pair_id", F.col("a").alias("x"), F.col("b").alias("y")), "a", "b", LABEL_MATRIX, LABEL_OPENED, LABEL_EXTENDED).select("pair_id", F.col("x").alias("a"), F.col("y").alias("b"), F.col("score").alias("score_ab"))


def triplets(keys: DataFrame, key: str, size: int = 24, mutations: int = 2) -> DataFrame:
    """(pair_id, anchor, positive, negative, phase): windows of one parent of 64 symbols for each key.

    The positive is the anchor moved by a phase of -4..3 with point mutations; the negative is moved by one step more and has
    one mutation more. Everything follows from the key. Cases whose positive equals their negative are discarded.
    """
    h = lambda n: F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("pair_id").cast("string"), F.lit(f"/{n}"))), 1, 8), 16, 10).cast("long"), F.lit(1 << 20))
    base = keys.select(F.col(key).alias("pair_id"))
    parent = F.concat(dna_of_key(F.col("pair_id")), dna_of_key(F.concat(F.lit("p"), F.col("pair_id").cast("string"))))
    start = F.lit(16)
    rows = base.select("pair_id", parent.alias("parent"), (F.pmod(h(0), F.lit(8)) - 4).cast("int").alias("phase"))
    rows = rows.select("pair_id", "phase", F.substr("parent", start + 1, F.lit(size)).alias("anchor"), F.substr("parent", start + F.col("phase") + 1, F.lit(size)).alias("p"), F.substr("parent", start + F.col("phase") + 2, F.lit(size)).alias("n"))
    positive, negative = F.col("p"), F.col("n")
    for i in range(mutations):
        positive = mutated(positive, F.pmod(h(2 * i + 1), F.lit(size)).cast("int"), F.pmod(h(2 * i + 2), F.lit(3)).cast("int"))
    for i in range(mutations + 1):
        negative = mutated(negative, F.pmod(h(2 * i + 31), F.lit(size)).cast("int"), F.pmod(h(2 * i + 32), F.lit(3)).cast("int"))
    return rows.select("pair_id", "anchor", positive.alias("positive"), negative.alias("negative"), "phase").where("positive <> negative")


#: Symbols that a mutation draws from: all of the nucleic alphabet and the gap.
MUTATION_SYMBOLS = "ACGTRYSWKMBDHVN-"
_WINDOW = 24
#: Steps that visit every place of a window once; each is its own inverse there.
_STEPS = (1, 5, 7, 11, 13, 17, 19, 23)


def _drawn(n: int) -> Column:
    """A number below 2^20 that any engine derives alike from pair_id and n."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("pair_id").cast("string"), F.lit(f"/{n}"))), 1, 8), 16, 10).cast("long"), F.lit(1 << 20))


def mutated_at_distinct(text: Column, mutations: Column, first: int) -> Column:
    """text of 24 symbols of A, C, G, T with so many mutations at different places, each to another of the 16 symbols. The places are
    those of a walk through the window; walk and symbols follow from the numbers drawn as `first` and the next two."""
    step, start, shift = F.element_at(F.array(*map(F.lit, _STEPS)), (_drawn(first) % len(_STEPS) + 1).cast("int")), _drawn(first + 1) % _WINDOW, _drawn(first + 2)
    letters = F.lit(MUTATION_SYMBOLS)

    def symbol(j: Column) -> Column:
        old = F.substr(text, j + 1, F.lit(1))
        turn = F.pmod(step * (j - start), F.lit(_WINDOW))
        new = F.pmod(F.instr(letters, old) - 1 + (shift + 7 * turn) % 15 + 1, F.lit(len(MUTATION_SYMBOLS)))
        return F.when(turn < mutations, F.substr(letters, (new + 1).cast("int"), F.lit(1))).otherwise(old)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(_WINDOW - 1)), symbol), "")


def scored_triplets(keys: DataFrame, key: str) -> DataFrame:
    """(pair_id, anchor, positive, negative, phase, mutations, score_ap, score_an, scaled_ap, scaled_an): training triplets of 24 symbols.

    The positive is the anchor's parent moved by a phase of -4..3, with 0 to 9 mutations at distinct places; the negative is moved by one
    step more, or has one mutation more, or both: cases where neither holds are rejected, and so are those whose two alignment
    scores are equal. Both scores are scaled to 0..1 by their joint minimum and maximum over all that is left.
    """
    base = keys.select(F.col(key).alias("pair_id")).distinct()
    parent = F.concat(dna_of_key(F.col("pair_id")), dna_of_key(F.concat(F.lit("p"), F.col("pair_id").cast("string"))))
    rows = base.select("pair_id", parent.alias("parent"), (_drawn(0) % 8 - 4).cast("int").alias("phase"), (_drawn(1) % 2).cast("int").alias("steps"), (_drawn(2) % 10).cast("int").alias("mutations"), (_drawn(3) % 2).cast("int").alias("more"))
    rows = rows.where("steps > 0 OR more > 0")
    cut_at = lambda by: F.substr("parent", (F.lit(17) + by).cast("int"), F.lit(_WINDOW))
    away = F.col("phase") + F.when(F.col("phase") < 0, -F.col("steps")).otherwise(F.col("steps"))
    rows = rows.select("pair_id", "phase", "mutations", "more", cut_at(F.lit(0)).alias("anchor"), cut_at(F.col("phase")).alias("p"), cut_at(away).alias("n"))
    rows = rows.select("pair_id", "phase", "mutations", "anchor", mutated_at_distinct(F.col("p"), F.col("mutations"), 4).alias("positive"), mutated_at_distinct(F.col("n"), F.col("mutations") + F.col("more"), 7).alias("negative"))
    rest = ["pair_id", "phase", "mutations"]
    one = with_scores(rows.select("anchor", "positive", *rest, "negative"), "anchor", "positive", LABEL_MATRIX, LABEL_OPENED, LABEL_EXTENDED).withColumnRenamed("score", "score_ap")
    both = with_scores(one.select("anchor", "negative", *rest, "positive", "score_ap"), "anchor", "negative", LABEL_MATRIX, LABEL_OPENED, LABEL_EXTENDED).withColumnRenamed("score", "score_an")
    kept = cut(both.where("score_ap <> score_an").withColumns({"scaled_ap": F.col("score_ap").cast("double"), "scaled_an": F.col("score_an").cast("double")}))
    return min_max_scaled(kept, "scaled_ap", "scaled_an")


def sampled_triples(rows: DataFrame, key: str, seed: str = "s") -> DataFrame:
    """(triple, anchor, positive, negative): three different rows each, in the order of a seeded hash of the key; each row is in one triple
    at most, and one or two may be left over. The order is numbered by ranges, so no task sees all rows."""
    ordered = numbered(rows.select(F.col(key).alias("_key"), F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))).alias("_order")), ["_order", "_key"], "_n")
    role = (F.col("_n") - 1) % 3
    by_role = [F.max(F.when(role == i, F.col("_key"))).alias(name) for i, name in enumerate(("anchor", "positive", "negative"))]
    return ordered.groupBy(F.floor((F.col("_n") - 1) / 3).alias("triple")).agg(*by_role).where("negative IS NOT NULL")


def min_max_scaled(df: DataFrame, *columns: str) -> DataFrame:
    """df with the columns scaled to 0..1 by their joint minimum and maximum; null where all values are equal."""
    low, high = F.min(F.least(*columns)) if len(columns) > 1 else F.min(columns[0]), F.max(F.greatest(*columns)) if len(columns) > 1 else F.max(columns[0])
    bounds = df.agg(low.alias("_low"), high.alias("_high"))
    scaled = {c: F.try_divide(F.col(c) - F.col("_low"), F.col("_high") - F.col("_low")) for c in columns}
    return df.crossJoin(F.broadcast(bounds)).withColumns(scaled).drop("_low", "_high")  # bounds: one row


def first_share(df: DataFrame, by: list[str], share: float = 0.8) -> DataFrame:
    """df with a boolean column `train`: true for the first share of the rows in the order of `by`."""
    total = df.agg(F.count("*").alias("_total"))
    return numbered(df, by, "_number").crossJoin(F.broadcast(total)).withColumn("train", F.col("_number") <= F.floor(F.col("_total") * share)).drop("_number", "_total")


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts in `bins` bins of equal width over low..high, the upper end in the last one; values outside are left out."""
    kept = df.select(value.alias("v")).where((F.col("v") >= low) & (F.col("v") <= high))
    return kept.groupBy(F.least(F.width_bucket("v", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ranking_match(triples: DataFrame) -> DataFrame:
    """One row (triples, matches, match_rate, errors, mean_error) for triples(score_ap, score_an, near_ap, near_an): how often scores and
    nearness rank p and n alike. Equal scores are left out; equal nearness is a mismatch. Errors: n nearer than p
    though p scores higher, by how much on average."""
    kept = triples.where("score_ap <> score_an")
    agree = F.signum(F.col("score_ap") - F.col("score_an")) == F.signum(F.col("near_ap") - F.col("near_an"))
    wrong = (F.col("score_ap") > F.col("score_an")) & (F.col("near_an") > F.col("near_ap"))
    return kept.agg(
        F.count("*").alias("triples"), F.count_if(agree).alias("matches"), F.try_divide(F.count_if(agree), F.count("*")).alias("match_rate"),
        F.count_if(wrong).alias("errors"), F.avg(F.when(wrong, F.col("near_an") - F.col("near_ap"))).alias("mean_error"),
    )


def triplet_loss(near_ap: Column, near_an: Column, score_ap: Column, score_an: Column, margin: float = 0.1) -> Column:
    """Aggregate: mean squared errors of both nearnesses against their scores, plus the largest hinge of a batch."""
    return F.avg(F.pow(near_ap - score_ap, 2)) + F.avg(F.pow(near_an - score_an, 2)) + F.max(F.greatest(near_an - near_ap + margin, F.lit(0.0)))


def vector_pairs(vectors: DataFrame) -> DataFrame:
    """(vec_id, other, near): each vector with the one of the next id, and their cosine."""
    right = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e"))
    return vectors.join(right, "vec_id").select("vec_id", "other", cosine(F.col("embedding"), F.col("e")).alias("near"))
