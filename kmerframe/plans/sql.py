"""Pieces of SQL that several checks share."""

#: One row (seq_id, sequence) per read.
ONCE = "once AS (SELECT seq_id, min(sequence) AS sequence FROM reads WHERE seq_id IS NOT NULL AND sequence IS NOT NULL GROUP BY seq_id)"
#: Usable vectors, each once.
USABLE = """usable AS (
  SELECT vec_id, arg_min(config_id, r) AS config_id, arg_min(kmer, r) AS kmer, arg_min(repr, r) AS repr, arg_min(embedding, r)::DOUBLE[] AS e
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at NULLS LAST) AS r FROM kmer_embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
  GROUP BY vec_id)"""


def dna(key: str) -> str:
    return f"translate(md5(CAST({key} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def cosine(a: str, b: str) -> str:
    return f"({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0))"


def smith_waterman(pairs: str, match: int, mismatch: int, opened: int, extended: int, name: str = "sw", free: str = "") -> str:
    """CTEs that give name(id, score) for pairs(id, a, b) of short texts of A, C, G, T. Needs WITH RECURSIVE. free: symbols that
    score 0 against all."""
    base = opened - extended
    apart = f"WHEN contains('{free}', a[i + 1]) OR contains('{free}', b[j]) THEN 0 " if free else ""
    return f"""
{name}_rows AS (
  SELECT id, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: 0) AS h, list_transform(range(0, length(b)), lambda j: -1000000) AS e, 0 AS best FROM {pairs}
  UNION ALL
  SELECT id, a, b, i, [0] || h2 AS h, list_transform(range(1, length(b) + 1), lambda j: greatest(e[j] - {extended}, h2[j] - {opened})) AS e, greatest(best, list_max(h2)) AS best
  FROM (SELECT id, a, b, i, e, best, list_transform(range(1, length(b) + 1), lambda j: CASE WHEN j = 1 THEN t[1] ELSE greatest(t[j], list_max(list_transform(range(1, j), lambda l: t[l] + l * {extended})) - j * {extended} - {base}) END) AS h2
        FROM (SELECT id, a, b, i + 1 AS i, e, best, list_transform(range(1, length(b) + 1), lambda j: greatest(0, e[j], h[j] + CASE {apart}WHEN a[i + 1] = b[j] THEN {match} ELSE {mismatch} END)) AS t
              FROM {name}_rows WHERE i < length(a)))),
{name} AS (SELECT id, max(best) AS score FROM {name}_rows GROUP BY id)"""
