"""Queries on sequence graphs. Each read gives a graph of five nodes: its four quarters in a row, an epsilon edge beside the second
quarter and the reversed third quarter beside the third."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerframe.operators import graphs as G
from kmerframe.plans.reads import reads_once
from kmerframe.plans.registry import query
from kmerframe.plans.sql import ONCE
from kmerframe.runtime import table

STEP = 5

EDGES = f"""{ONCE}, q AS (SELECT seq_id AS graph_id, sequence AS s, length(sequence) // 4 AS n FROM once WHERE length(sequence) >= 32),
edges AS (
  SELECT graph_id, 0 AS edge_id, 0 AS src, 1 AS dst, substr(s, 1, n) AS label FROM q
  UNION ALL SELECT graph_id, 1, 1, 2, substr(s, n + 1, n) FROM q
  UNION ALL SELECT graph_id, 2, 2, 3, substr(s, 2 * n + 1, n) FROM q
  UNION ALL SELECT graph_id, 3, 3, 4, substr(s, 3 * n + 1) FROM q
  UNION ALL SELECT graph_id, 4, 1, 2, NULL FROM q
  UNION ALL SELECT graph_id, 5, 2, 3, reverse(substr(s, 2 * n + 1, n)) FROM q)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = reads_once(spark, sf_dir).where(F.length("sequence") >= 32).select(F.col("seq_id").alias("graph_id"), F.col("sequence").alias("s"), F.expr("length(sequence) div 4").cast("int").alias("n"))
    part = lambda i: F.substr("s", i * F.col("n") + 1, F.col("n"))
    rows = [(0, 0, 1, part(0)), (1, 1, 2, part(1)), (2, 2, 3, part(2)), (3, 3, 4, F.substr("s", 3 * F.col("n") + 1)), (4, 1, 2, F.lit(None).cast("string")), (5, 2, 3, F.reverse(part(2)))]
    made = F.array(*[F.struct(F.lit(e).alias("edge_id"), F.lit(a).alias("src"), F.lit(b).alias("dst"), label.alias("label")) for e, a, b, label in rows])
    return q.select("graph_id", F.inline(made))


def _ends(rows: DataFrame) -> DataFrame:
    return rows.where("edge_id = 0").select("graph_id", F.lit(0).alias("start_node"), F.lit(4).alias("end_node"))


PATHS = f"""{EDGES}, ways AS (
  SELECT graph_id, 0 AS node, '' AS path, 0 AS n, '' AS text FROM q
  UNION ALL SELECT w.graph_id, e.dst, CASE WHEN label IS NULL THEN path ELSE path || '/' || edge_id END, w.n + (label IS NOT NULL)::INT, text || coalesce(label, '')
  FROM ways w JOIN edges e ON e.graph_id = w.graph_id AND e.src = w.node WHERE w.node <> 4)"""


@query("graph_paths", f"WITH RECURSIVE {PATHS} SELECT graph_id, substr(path, 2) AS path, n AS edges, length(text) AS symbols, md5(text) AS text FROM ways WHERE node = 4 AND n > 0")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    return G.all_paths(rows, _ends(rows)).select("graph_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.size("path").alias("edges"), F.length("text").alias("symbols"), F.md5("text").alias("text"))


@query("graph_path_lengths", f"WITH RECURSIVE {PATHS} SELECT n AS edges, count(*) AS paths, sum(length(text))::BIGINT AS symbols FROM ways WHERE node = 4 AND n > 0 GROUP BY n")
def graph_path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    return G.all_paths(rows, _ends(rows)).groupBy(F.size("path").alias("edges")).agg(F.count("*").alias("paths"), F.sum(F.length("text")).alias("symbols"))


@query("cursor_consumed_down", f"WITH {EDGES} SELECT graph_id, substr(label, 1, {STEP}) AS first, substr(label, {STEP + 1}, {STEP - 2}) AS second, 0 AS edge_id, {2 * STEP - 2} AS off FROM edges WHERE edge_id = 0 AND length(label) > {2 * STEP - 2} UNION ALL SELECT graph_id, substr(label, 1, {STEP}), substr(label, {STEP + 1}, {STEP - 2}), NULL, NULL FROM edges WHERE edge_id = 0 AND length(label) = {2 * STEP - 2}")
def cursor_consumed_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    start = G.cursors_at(rows, rows.where("edge_id = 0").select("graph_id", F.lit(0).alias("node_id")))
    one = G.consumed(start, rows, STEP)
    two = G.consumed(one.drop("text"), rows, STEP - 2).withColumnRenamed("text", "second")
    return two.join(one.select("graph_id", F.col("text").alias("first")), "graph_id").select("graph_id", "first", "second", "edge_id", "off")


@query("cursor_consumed_up", f"WITH {EDGES} SELECT graph_id, reverse(right(label, {STEP})) AS text, 3 AS edge_id, length(label) - 1 - {STEP} AS off FROM edges WHERE edge_id = 3")
def cursor_consumed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    start = G.cursors_at(rows, rows.where("edge_id = 0").select("graph_id", F.lit(4).alias("node_id")), down=False)
    return G.consumed(start, rows, STEP, down=False).select("graph_id", "text", "edge_id", "off")


_AGREE = "coalesce(list_min(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substr({0}, i, 1) <> substr({1}, i, 1))) - 1, least(length({0}), length({1})))"


@query("match_lengths", f"""
WITH {EDGES}, p AS (SELECT x.graph_id, x.label AS a, y.label AS b FROM edges x JOIN edges y ON x.graph_id = y.graph_id AND x.edge_id = 2 AND y.edge_id = 5)
SELECT graph_id, {_AGREE.format("a", "b")}::INT AS down, {_AGREE.format("reverse(a)", "reverse(b)")}::INT AS up FROM p
""")
def match_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    pairs = rows.where("edge_id = 2").select("graph_id", F.col("label").alias("a")).join(rows.where("edge_id = 5").select("graph_id", F.col("label").alias("b")), "graph_id")
    a, b = F.col("a"), F.col("b")
    return pairs.select("graph_id", G.match_length(a, F.lit(0), b, F.lit(0)).alias("down"), G.match_length(a, F.length(a) - 1, b, F.length(b) - 1, down=False).alias("up"))


@query("matching_edges_down", f"""
WITH {EDGES}, roots AS (SELECT graph_id, 1 AS root, unnest(['A', 'C', 'G', 'T']) AS symbol FROM q),
near AS (SELECT graph_id, edge_id, substr(label, 1, 1) AS symbol FROM edges WHERE src IN (1, 2) AND label <> '')
SELECT r.graph_id, root, r.symbol, min(edge_id) IS NOT NULL AS found, min(edge_id) AS edge_id, CASE WHEN min(edge_id) IS NOT NULL THEN 0 END AS off
FROM roots r LEFT JOIN near n ON n.graph_id = r.graph_id AND n.symbol = r.symbol GROUP BY ALL
""")
def matching_edges_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    roots = rows.where("edge_id = 0").select("graph_id", F.lit(1).cast("long").alias("root"), F.explode(F.array(*map(F.lit, "ACGT"))).alias("symbol"))
    return G.matching_edges(rows, roots)


@query("matching_edges_up", f"""
WITH {EDGES}, roots AS (SELECT graph_id, 2 AS root, unnest(['A', 'C', 'G', 'T']) AS symbol FROM q),
near AS (SELECT graph_id, edge_id, right(label, 1) AS symbol, length(label) - 1 AS off FROM edges WHERE dst IN (1, 2) AND label <> '')
SELECT r.graph_id, root, r.symbol, min(edge_id) IS NOT NULL AS found, min(edge_id) AS edge_id, arg_min(off, edge_id) AS off
FROM roots r LEFT JOIN near n ON n.graph_id = r.graph_id AND n.symbol = r.symbol GROUP BY ALL
""")
def matching_edges_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    roots = rows.where("edge_id = 0").select("graph_id", F.lit(2).cast("long").alias("root"), F.explode(F.array(*map(F.lit, "ACGT"))).alias("symbol"))
    return G.matching_edges(rows, roots, down=False)


@query("edge_names", f"WITH {EDGES} SELECT graph_id, edge_id, CASE WHEN label IS NULL THEN 'E' || edge_id || ' &epsilon;' ELSE 'E' || edge_id || '[' || length(label) || ']' END AS name FROM edges")
def edge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("graph_id", "edge_id", G.edge_name(F.col("edge_id"), F.col("label")).alias("name"))


@query("graph_edits", f"""
WITH {EDGES} SELECT graph_id, edge_id, src, dst FROM edges WHERE edge_id <> 4 UNION ALL SELECT graph_id, 6, 0, 4 FROM q
""")
def graph_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epsilon edge taken out, and a short cut put in."""
    rows = edges(spark, sf_dir)
    short = rows.where("edge_id = 0").select("graph_id", F.lit(6).alias("edge_id"), F.lit(0).alias("src"), F.lit(4).alias("dst"), F.lit(None).cast("string").alias("label"))
    return G.add_rows(G.remove_rows(rows, rows.where("edge_id = 4"), "graph_id", "edge_id"), short).select("graph_id", "edge_id", "src", "dst")


_N = lambda n, red=False: f"'  N{n} [label=\"N{n}\"{' color=red' if red else ''}];'"
_E = lambda a, b, e, name, red=False: f"'  N{a} -> N{b} [label=\"' || {name} || '\"{' color=red' if red else ''}];'"
_LEN = lambda e, x: f"'E{e}[' || {x} || ']'"


@query("dot_export", f"""
WITH {ONCE}, q AS (SELECT seq_id AS graph_id, length(sequence) // 4 AS n FROM once WHERE length(sequence) >= 32)
SELECT graph_id, concat_ws(chr(10), 'digraph {{', {_N(1)}, {_N(2, True)}, {_N(3)}, '  N0 [label="N0..."];', '  N4 [label="N4..."];',
  {_E(1, 2, 1, _LEN(1, "n"))}, {_E(2, 3, 2, _LEN(2, "n"), True)}, {_E(1, 2, 4, "'E4 &epsilon;'")}, {_E(2, 3, 5, _LEN(5, "n"))}, '}}') AS dot FROM q
""")
def dot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    return G.dot(rows, G.cursors_at(rows, rows.where("edge_id = 0").select("graph_id", F.lit(2).alias("node_id"))), 1)


@query("read_graph_edges", f"WITH {ONCE} SELECT m.graph_id, 0 AS edge_id, 0 AS src, 1 AS dst, md5(sequence) AS label FROM membership m JOIN once USING (seq_id) WHERE m.graph_id IS NOT NULL")
def read_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, rows = G.read_graphs(reads_once(spark, sf_dir), table(spark, sf_dir, "membership"))
    return rows.withColumn("label", F.md5("label"))
