"""Sequence graphs as tables: edges(graph_id, edge_id, src, dst, label), where a null label is an epsilon edge.

All operators work on any number of graphs at once; `graph_id` is the key of every join and group.
Cursors are (graph_id, node_id, edge_id, off), edge_id null at a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerframe.functions.sequences import common_prefix
from kmerframe.runtime import cut


def read_graphs(reads: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes, edges): one graph per member, two nodes and one edge that carries the whole read."""
    rows = membership.where("graph_id IS NOT NULL").join(reads.select("seq_id", "sequence"), "seq_id").select("graph_id", "sequence")
    graphs = rows.select("graph_id", F.lit(0).alias("start_node"), F.lit(1).alias("end_node"))
    nodes = rows.select("graph_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("node_id"))
    edges = rows.select("graph_id", F.lit(0).alias("edge_id"), F.lit(0).alias("src"), F.lit(1).alias("dst"), F.col("sequence").alias("label"))
    return graphs, nodes, edges


def add_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes or edges with others added; parallel edges stay apart by their ids."""
    return table.unionByName(rows)


def remove_rows(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Nodes or edges without those named by key. Edges at a removed node stay, as they name it only."""
    return table.join(rows.select(*key), list(key), "left_anti")


def edge_name(edge_id: Column, label: Column) -> Column:
    return F.when(label.isNull(), F.format_string("E%d &epsilon;", edge_id)).otherwise(F.format_string("E%d[%d]", edge_id, F.length(label)))


def all_paths(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(graph_id, path, text): every way from start_node to end_node of ends(graph_id, start_node, end_node).

    path holds the ids of the edges with a label, in order; epsilon edges leave no trace, and ways of epsilons only are dropped.
    Parallel edges give ways of their own. A way ends where it first reaches the end, and passes no node twice, so cycles
    end too. Each step joins all open ways of all graphs with the edges; there are as many steps as the longest way has edges.
    """
    edges = edges.select("graph_id", "edge_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "label")
    open_ways = ends.select(
        "graph_id", F.col("start_node").cast("long").alias("at"), F.col("end_node").cast("long").alias("end"), F.array(F.col("start_node").cast("long")).alias("seen"),
        F.array().cast("array<long>").alias("path"), F.lit("").alias("text"),
    )
    done: DataFrame | None = None
    while True:
        step = open_ways.withColumnRenamed("at", "src").join(edges, ["graph_id", "src"]).where(~F.array_contains("seen", F.col("dst")))
        step = cut(
            step.select(
                "graph_id", F.col("dst").alias("at"), "end", F.concat("seen", F.array("dst")).alias("seen"),
                F.when(F.col("label").isNull(), F.col("path")).otherwise(F.concat("path", F.array(F.col("edge_id").cast("long")))).alias("path"),
                F.concat("text", F.coalesce("label", F.lit(""))).alias("text"),
            )
        )
        arrived = step.where("at = end AND size(path) > 0").select("graph_id", "path", "text")
        done = arrived if done is None else done.unionByName(arrived)
        open_ways = step.where("at <> end")
        if open_ways.isEmpty():
            return done


def epsilon_closure(edges: DataFrame, roots: DataFrame, down: bool = True) -> DataFrame:
    """(graph_id, root, node_id): nodes that epsilon edges lead to from roots(graph_id, root), the root included; down along the
    edges, or up against them."""
    here, there = ("src", "dst") if down else ("dst", "src")
    hops = edges.where("label IS NULL").select("graph_id", F.col(here).cast("long").alias("node_id"), F.col(there).cast("long").alias("next")).distinct()
    seen = frontier = cut(roots.select("graph_id", F.col("root").cast("long").alias("root"), F.col("root").cast("long").alias("node_id")).distinct())
    while True:
        frontier = frontier.join(hops, ["graph_id", "node_id"]).select("graph_id", "root", F.col("next").alias("node_id")).distinct()
        frontier = cut(frontier.join(seen, ["graph_id", "root", "node_id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def matching_edges(edges: DataFrame, roots: DataFrame, down: bool = True) -> DataFrame:
    """(graph_id, root, symbol, found, edge_id, off) for roots(graph_id, root, symbol): the edge of smallest id that, through epsilon
    edges from the root, begins (down) or, against the edges, ends (up) with the symbol; off is the symbol's place in the edge."""
    near = epsilon_closure(edges, roots, down)
    side = "src" if down else "dst"
    labelled = edges.where("label <> ''").select(
        "graph_id", F.col(side).cast("long").alias("node_id"), "edge_id", (F.lit(0) if down else F.length("label") - 1).alias("off"), (F.substring("label", 1, 1) if down else F.right("label", F.lit(1))).alias("symbol")
    )
    found = near.join(labelled, ["graph_id", "node_id"]).groupBy("graph_id", "root", "symbol").agg(F.min(F.struct("edge_id", "off")).alias("e"))
    return roots.join(found, ["graph_id", "root", "symbol"], "left").select("graph_id", "root", "symbol", F.col("e").isNotNull().alias("found"), "e.edge_id", "e.off")


def cursors_at(edges: DataFrame, places: DataFrame, down: bool = True) -> DataFrame:
    """Cursors of places(graph_id, node_id): each enters the first edge by id that leaves its node (down, off 0) or comes to it
    (up, off at its last symbol). Where there is none edge_id and off are null."""
    side = "src" if down else "dst"
    first = edges.groupBy("graph_id", F.col(side).alias("node_id")).agg(F.min(F.struct("edge_id", "label")).alias("e"))
    off = F.lit(0) if down else F.length("e.label") - 1
    return places.join(first, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "e.edge_id", F.when(F.col("e").isNotNull(), off).alias("off"))


def consumed(cursors: DataFrame, edges: DataFrame, n: int, down: bool = True) -> DataFrame:
    """Cursors after n symbols of their edge, with what was read in `text`: onwards going down, reversed going up.

    A cursor that comes to the end of its edge stands at the far node with no edge. It must have n symbols left: text is null,
    and the cursor stays, where it hasn't.
    """
    joined = cursors.join(edges.select("graph_id", "edge_id", "src", "dst", "label"), ["graph_id", "edge_id"], "left")
    left = (F.length("label") - F.col("off")) if down else F.col("off") + 1
    ok = F.coalesce(left >= n, F.lit(False))
    taken = F.substr("label", F.col("off") + 1, F.lit(n)) if down else F.reverse(F.substr("label", F.col("off") - n + 2, F.lit(n)))
    ends = ok & (left == n)
    after = F.col("off") + n if down else F.col("off") - n
    return joined.select(
        "graph_id", F.when(ends, F.col("dst" if down else "src")).otherwise(F.col("node_id")).alias("node_id"), F.when(~ends, F.col("edge_id")).alias("edge_id"),
        F.when(~ok, F.col("off")).when(~ends, after).alias("off"), F.when(ok, taken).alias("text"),
    )


def match_length(a: Column, a_off: Column, b: Column, b_off: Column, down: bool = True) -> Column:
    """Number of symbols that agree in two edges from the offsets on, forwards (down) or backwards (up); edges are not left."""
    if down:
        return common_prefix(F.substr(a, a_off + 1), F.substr(b, b_off + 1))
    return common_prefix(F.reverse(F.substr(a, F.lit(1), a_off + 1)), F.reverse(F.substr(b, F.lit(1), b_off + 1)))


def same_cursor(a: str, b: str) -> Column:
    """Whether two cursors (struct columns) are equal: graph and node, and both without an edge or with equal edge and offset."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    edge = (x("edge_id").isNull() & y("edge_id").isNull()) | (x("edge_id").eqNullSafe(y("edge_id")) & x("off").eqNullSafe(y("off")))
    return x("graph_id").eqNullSafe(y("graph_id")) & x("node_id").eqNullSafe(y("node_id")) & edge


def dot(edges: DataFrame, cursors: DataFrame, max_dist: int) -> DataFrame:
    """(graph_id, dot): the neighbourhood of each graph's cursor as a Graphviz digraph: up to max_dist edges against, and along the
    edges from the cursor's node. The cursor's node and edge are red; nodes just beyond the bound end in dots. A cursor without
    a node gives an empty digraph. Each node and edge comes once, in order of ids."""
    edges = edges.select("graph_id", "edge_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "label")
    root = cursors.where("node_id IS NOT NULL").select("graph_id", F.col("node_id").cast("long").alias("node"))
    inside, used = root, None
    for here, there in (("dst", "src"), ("src", "dst")):
        front = root
        for _ in range(max_dist):
            hop = cut(front.select("graph_id", F.col("node").alias(here)).join(edges, ["graph_id", here]).select("graph_id", "edge_id", "src", "dst", "label").distinct())
            used = hop if used is None else used.unionByName(hop)
            front = hop.select("graph_id", F.col(there).alias("node")).distinct()
            inside = inside.unionByName(front)
    inside = inside.distinct()
    used = edges.limit(0) if used is None else used.distinct()
    beyond = edges.join(inside.select("graph_id", F.col("node").alias("src")), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node"))
    beyond = beyond.unionByName(edges.join(inside.select("graph_id", F.col("node").alias("dst")), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node"))).distinct().join(inside, ["graph_id", "node"], "left_anti")
    at = cursors.select("graph_id", F.col("node_id").cast("long").alias("c_node"), F.col("edge_id").alias("c_edge"))
    red = lambda c: F.when(c, " color=red").otherwise("")
    nodes = inside.join(at, "graph_id").select("graph_id", F.lit(0).alias("o"), F.col("node").alias("i"), F.format_string('  N%d [label="N%d"%s];', "node", "node", red(F.col("node") == F.col("c_node"))).alias("line"))
    far = beyond.select("graph_id", F.lit(1).alias("o"), F.col("node").alias("i"), F.format_string('  N%d [label="N%d..."];', "node", "node").alias("line"))
    arcs = used.join(at, "graph_id").select(
        "graph_id", F.lit(2).alias("o"), F.col("edge_id").cast("long").alias("i"),
        F.format_string('  N%d -> N%d [label="%s"%s];', "src", "dst", edge_name(F.col("edge_id"), F.col("label")), red(F.coalesce(F.col("edge_id") == F.col("c_edge"), F.lit(False)))).alias("line"),
    )
    lines = nodes.unionByName(far).unionByName(arcs).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("o", "i", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return cursors.select("graph_id").join(lines, "graph_id", "left").select("graph_id", F.concat(F.lit("digraph {\n"), F.coalesce(F.concat(body, F.lit("\n")), F.lit("")), F.lit("}")).alias("dot"))
