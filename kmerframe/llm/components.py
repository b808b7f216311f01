"""Problem 2: one group identifier for all records that are linked directly or through others.

1. Links become undirected edges, without loops, each once. Both directions (arcs) are written once, partitioned and sorted by
   their start, so that a step of the search shuffles its frontier only. A vertex with more arcs than a fair share of a task
   is cut into chunks of that size, each with a place of its own.
2. The component of the vertex with most links is peeled whole: a breadth-first search from that vertex, one join of the
   frontier with the arcs per level, until the frontier is empty. The neighbours of a level lie in the level before, in
   itself and in the next one, so a step needs the last two levels only, not all that was reached. HOPS levels are planned as one
   job, so a component with long thin ends costs a job per HOPS levels.
3. What the search reached is taken out of the graph by an anti-join.
4. The rest is labelled by minimum propagation. Each round links every vertex to the smallest vertex of its
   neighbourhood, first among its larger neighbours, then among its smaller ones, so paths halve and the number of
   rounds grows with the logarithm of the longest path only. It ends when a round changes nothing.

Edges and vertices never reach the driver; it sees one vertex and one count per round. Each round is
written to the shared checkpoint folder. Minima and duplicates are combined before the shuffle, so a vertex that is in a third of all
rows costs one row per task; joins on it are split by adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerframe.runtime import cut, shuffle_width

#: Levels of the search that run as one job; it changes the number of jobs only.
HOPS = 8


def undirected(links: DataFrame, a: str, b: str) -> DataFrame:
    """Edges (u, v) with u < v, each once; rows with a null end and loops are left out."""
    return (
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v"))
        .distinct()
    )


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _laid_out(df: DataFrame) -> DataFrame:
    """df, cut so that its partitioning and order are kept; adaptive execution, which would merge partitions, rests meanwhile."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def _arcs(edges: DataFrame) -> tuple[DataFrame, int | None, int]:
    """(arcs, root, chunks of the root). arcs(u, c, to, n): chunk c of the arcs of u, each to a vertex that has n chunks, and for
    each chunk an arc to itself. root: the vertex with most arcs, the smallest of them; None for no edges."""
    width = shuffle_width(edges.sparkSession)
    both = _both(edges)
    degrees = cut(both.groupBy("u").agg(F.count("*").alias("degree")))
    root = degrees.orderBy(F.desc("degree"), "u").first()
    if root is None:
        return degrees, None, 0
    limit = max(1000, -(-(degrees.agg(F.sum("degree")).first()[0]) // (4 * width)))
    # degrees add up to the number of arcs, so fewer than 4 * width vertices have so many
    heavy = F.broadcast(degrees.where(f"degree > {limit}").select(F.col("u").alias("x"), F.ceil(F.col("degree") / limit).cast("int").alias("k")))
    chunks = lambda column: F.coalesce(column, F.lit(1))
    arcs = (
        both.join(heavy.toDF("u", "ku"), "u", "left").join(heavy.toDF("v", "kv"), "v", "left")
        .select("u", F.pmod(F.xxhash64("v"), chunks(F.col("ku"))).cast("int").alias("c"), F.col("v").alias("to"), chunks(F.col("kv")).alias("n"))
    )
    loops = (
        degrees.join(heavy.toDF("u", "k"), "u", "left").select("u", chunks(F.col("k")).alias("n"))
        .select("u", F.explode(F.expr("sequence(0, n - 1)")).alias("c"), F.col("u").alias("to"), "n")
    )
    return _laid_out(arcs.unionByName(loops).repartition(width, "u", "c").sortWithinPartitions("u", "c")), root["u"], max(1, -(-root["degree"] // limit))


def peel(edges: DataFrame, hops: int = HOPS) -> DataFrame | None:
    """(v, level) of all vertices of the component of the vertex with most links (the smallest of them), with their distance from
    it. None for no edges. hops: levels that run as one job, 1 to HOPS.
    """
    hops = min(max(1, hops), HOPS)
    arcs, root, chunks = _arcs(edges)
    if root is None:
        return None
    front = edges.sparkSession.createDataFrame([(root, c, 0) for c in range(chunks)], "u long, c int, d int")
    seen, level = [front.select("u", F.col("d").alias("level"))], 0
    while True:
        reached = front  # d counts from this job's first level, so that all jobs have the same compiled code
        for step in range(hops):
            # a vertex of this level reaches its neighbours; those of other levels reach themselves only
            out = reached.join(arcs, ["u", "c"]).where(f"u = to OR d = {step}")
            out = out.select(F.col("to").alias("v"), "n", F.when(F.col("u") == F.col("to"), F.col("d")).otherwise(step + 1).alias("d"), F.when(F.col("u") == F.col("to"), F.col("c")).alias("own"))
            out = out.select(F.col("v").alias("u"), F.explode(F.expr("CASE WHEN own IS NULL THEN sequence(0, n - 1) ELSE array(own) END")).alias("c"), "d")
            reached = out.groupBy("u", "c").agg(F.min("d").alias("d"))
        wave = _laid_out(reached)
        seen.append(wave.where("d > 0").select("u", (F.col("d") + level).alias("level")))
        level += hops
        if wave.where(f"d = {hops}").isEmpty():
            return cut(reduce(DataFrame.unionByName, seen).select(F.col("u").alias("v"), "level").distinct())
        front = wave.where(f"d >= {hops - 1}").withColumn("d", F.col("d") - hops)


def propagate(edges: DataFrame) -> DataFrame:
    """(v, label) with the smallest vertex of its component for every vertex that is not itself smallest.

    edges(u, v) may be in any order. Each step is a minimum per vertex, joined back to the edges of that vertex.
    """
    now = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = -1
    while True:
        # larger neighbours go to the smallest vertex around
        arcs = _both(now)
        low = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = arcs.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        # smaller neighbours, and the vertex itself, go to the smallest of them
        least = star.groupBy("v").agg(F.min("u").alias("m"))
        after = star.join(least, "v")
        after = (
            after.where("u <> m").select(F.col("m").alias("x"), F.col("u").alias("y"))
            .unionByName(after.select(F.col("m").alias("x"), F.col("v").alias("y")))
            .distinct()
        )
        following = cut(after.select(F.col("x").alias("u"), F.col("y").alias("v")))
        # a star forest: every vertex hangs on one smaller vertex, which hangs on none
        state = following.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if (state["n"], state["s"]) == before:
            return following.select("v", F.col("u").alias("label"))
        before, now = (state["n"], state["s"]), following


def components(links: DataFrame, a: str, b: str, hops: int = HOPS) -> DataFrame:
    """(id, group_id) for each id with a link to another one; group_id is the smallest id reached, itself included.

    Loops and rows with a null end are no links; repeated and mirrored rows count once. An empty table gives no rows.
    """
    edges = cut(undirected(links, a, b))
    reached = peel(edges, hops)
    if reached is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    giant = reached.crossJoin(F.broadcast(reached.agg(F.min("v").alias("group_id")))).select(F.col("v").alias("id"), "group_id")  # one row
    labels = propagate(edges.join(reached.select(F.col("v").alias("u")), "u", "left_anti"))
    named = labels.select(F.col("v").alias("id"), F.col("label").alias("group_id"))
    roots = labels.select(F.col("label").alias("id"), F.col("label").alias("group_id")).distinct()
    return giant.unionByName(named).unionByName(roots)


def strong_links(joins: DataFrame, threshold: float = 200.0) -> DataFrame:
    """The rows of joins(gd_lo, gd_hi, norm_score) that link two graphs: a score of at least threshold, not null, not NaN."""
    return joins.where(F.col("norm_score").isNotNull() & ~F.isnan("norm_score") & (F.col("norm_score") >= threshold))
