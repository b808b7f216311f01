"""The pN_ queries and the SQL of those that SQL can express over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kmerframe.llm import components, frequency, mixing, neighbours, parity, residue, spans, tokens
from kmerframe.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: One row (seq_id, s) per read, s folded.
_FOLDED = "folded AS (SELECT seq_id, translate(upper(min(sequence)), 'U', 'T') AS s FROM reads WHERE sequence IS NOT NULL AND seq_id IS NOT NULL GROUP BY seq_id)"


def _windows(w: int, name: str) -> str:
    return (
        f"{name} AS (SELECT seq_id, i AS off, substr(s, i + 1, {w}) AS win FROM folded, LATERAL (SELECT unnest(range(0, length(s) - {w - 1})) AS i)"
        f" WHERE regexp_full_match(substr(s, i + 1, {w}), '[ACGT]+'))"
    )


@_query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_pairs(table(spark, sf_dir, "kmer_embeddings"), table(spark, sf_dir, "assembler_config"))


@_query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = components.strong_links(table(spark, sf_dir, "potential_joins"))
    return components.components(links, "gd_lo", "gd_hi").withColumnRenamed("id", "graph_id")


SQL["p2_found"] = """
WITH RECURSIVE links AS (
  SELECT DISTINCT least(gd_lo, gd_hi) AS u, greatest(gd_lo, gd_hi) AS v FROM potential_joins
  WHERE gd_lo <> gd_hi AND norm_score IS NOT NULL AND NOT isnan(norm_score) AND norm_score >= 200),
arcs AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (SELECT DISTINCT u AS graph_id, u AS other FROM arcs UNION SELECT graph_id, v FROM reached JOIN arcs ON other = u)
SELECT graph_id, min(other) AS group_id FROM reached GROUP BY graph_id
"""


@_query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.near_pairs(table(spark, sf_dir, "reads"))


@_query
def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.near_links(table(spark, sf_dir, "reads"))


_NEAR = f"""
{_FOLDED}, {_windows(12, "w12")},
toks AS (SELECT DISTINCT seq_id, win FROM w12),
sizes AS (SELECT seq_id, count(*) AS n FROM toks GROUP BY seq_id),
met AS (SELECT x.seq_id AS a, y.seq_id AS b, count(*) AS k FROM toks x JOIN toks y ON x.win = y.win AND x.seq_id < y.seq_id GROUP BY ALL),
near AS (SELECT a, b, k, x.n AS p, y.n AS q FROM met JOIN sizes x ON a = x.seq_id JOIN sizes y ON b = y.seq_id WHERE k * 10 >= (x.n + y.n - k) * 7)
"""

SQL["p3_found"] = f"WITH {_NEAR} SELECT a AS seq_lo, b AS seq_hi FROM near"
SQL["p3_links"] = f"""
WITH {_NEAR},
same AS (SELECT a, b FROM near WHERE k = p AND k = q),
classes AS (SELECT seq_id, coalesce((SELECT min(a) FROM same WHERE b = sizes.seq_id), seq_id) AS class_id FROM sizes),
ends AS (SELECT DISTINCT x.class_id AS c, y.class_id AS d FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) JOIN classes x ON a = x.seq_id JOIN classes y ON b = y.seq_id WHERE x.class_id <> y.class_id)
SELECT seq_id, class_id, (SELECT count(*) FROM ends WHERE c = class_id) AS links FROM classes
"""


@_query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.marked_terms(table(spark, sf_dir, "reads"), table(spark, sf_dir, "kmer_embeddings"))


SQL["p4_found"] = f"""
WITH {_FOLDED}, {_windows(10, "w10")}, {_windows(16, "w16")},
total AS (SELECT count(*) AS n FROM folded),
found AS (SELECT win, count(DISTINCT seq_id) AS records FROM w10 GROUP BY win),
seen AS (SELECT win, count(*) AS occurrences FROM w16 GROUP BY win),
recorded AS (SELECT DISTINCT translate(upper(kmer), 'U', 'T') AS kmer, weight FROM kmer_embeddings WHERE kmer IS NOT NULL AND weight IS NOT NULL)
SELECT win AS term, CASE WHEN records = 1 THEN 'rare' ELSE 'common' END AS mark FROM found, total WHERE records = 1 OR records * 20 >= n
UNION ALL
SELECT DISTINCT kmer AS term, 'miscounted' AS mark FROM recorded LEFT JOIN seen ON win = kmer WHERE weight <> coalesce(occurrences, 0)
"""


@_query
def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and reads of every window of 10."""
    return frequency.counted_terms(table(spark, sf_dir, "reads"))


SQL["p4_counts"] = f"WITH {_FOLDED}, {_windows(10, 'w10')} SELECT win AS term, count(*) AS occurrences, count(DISTINCT seq_id) AS records FROM w10 GROUP BY win"


@_query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_stretches(table(spark, sf_dir, "reads"), table(spark, sf_dir, "ref_seqs"))


_SHARED = f"""
WITH {_FOLDED}, {_windows(64, "w64")},
ref AS (SELECT ref_id, translate(upper(min(sequence)), 'U', 'T') AS s FROM ref_seqs WHERE sequence IS NOT NULL GROUP BY ref_id),
r64 AS (SELECT DISTINCT substr(s, i + 1, 64) AS win FROM ref, LATERAL (SELECT unnest(range(0, length(s) - 63)) AS i)),
several AS (SELECT win FROM w64 GROUP BY win HAVING count(DISTINCT seq_id) > 1 UNION SELECT win FROM r64),
hits AS (SELECT seq_id, off FROM w64 WHERE win IN (SELECT win FROM several)),
marked AS (SELECT seq_id, off, CASE WHEN off - lag(off) OVER (PARTITION BY seq_id ORDER BY off) <= 64 THEN 0 ELSE 1 END AS new FROM hits),
runs AS (SELECT seq_id, off, sum(new) OVER (PARTITION BY seq_id ORDER BY off) AS run FROM marked),
stretches AS (SELECT seq_id, min(off)::INT AS off, (max(off) + 64 - min(off))::INT AS len FROM runs GROUP BY seq_id, run)
"""
SQL["p5_found"] = f"{_SHARED} SELECT seq_id, off, len FROM stretches"
SQL["p5_share"] = f"{_SHARED} SELECT seq_id, length(s) AS length, coalesce((SELECT sum(len) FROM stretches t WHERE t.seq_id = folded.seq_id), 0)::BIGINT AS shared FROM folded"


@_query
def p5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each read is shared with others."""
    return spans.shared_share(table(spark, sf_dir, "reads"), table(spark, sf_dir, "ref_seqs"))


@_query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"))


@_query
def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@_query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@_query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents"))
