"""Problem 3: the scan that turns sorted segments into pairs, hot segments, and reads on one segment."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kmerframe.llm import parity, spans


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_pairs_of_sorted_segments(most):
    rng = np.random.default_rng(most)
    for trial in range(40):
        n = int(rng.integers(1, 80))
        key = np.sort(rng.integers(0, 8 if trial % 2 else 2, n))
        seq, size = rng.integers(0, 30, n), rng.integers(5, 9, n) * rng.choice([-1, 1], n)
        groups, want = defaultdict(list), set()
        for k, s, z in zip(key.tolist(), seq.tolist(), size.tolist(), strict=True):
            groups[k].append((s, z))
        near = lambda p, q: min(abs(p), abs(q)) * 10 >= max(abs(p), abs(q)) * 7 and (p > 0 or q > 0)
        pairs = {k: {(min(s, t), max(s, t)) for s, p in g for t, q in g if s != t and near(p, q)} for k, g in groups.items()}
        cuts = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 5)]))
        batches = [pa.record_batch([pa.array(key[a:b]), pa.array(seq[a:b]), pa.array(size[a:b].astype(np.int32))], names=["key", "seq_id", "n"]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        rows = [r for b in parity._met(iter(batches), most) for r in b.to_pylist()]
        hot = defaultdict(list)
        for r in rows:
            if r["hot"] is not None:
                hot[r["hot"]].append((r["a"], r["n"]))
        # a hot segment comes out whole
        assert all(sorted(v) == sorted(groups[k]) for k, v in hot.items())
        assert all(len(v) <= most for k, v in groups.items() if k not in hot)
        for k in groups:
            if k not in hot:
                want |= pairs[k]
        assert {(r["a"], r["b"]) for r in rows if r["hot"] is None} == want


def test_hot_segments_lose_no_pair(spark):
    rng = random.Random(8)
    base = "".join(rng.choices("ACGT", k=260))
    rows = []
    for i in range(60):
        s = list(base)
        for _ in range(rng.randrange(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        rows.append((i, "".join(s)))
    df = spark.createDataFrame(rows, "seq_id long, sequence string")
    want = sorted(tuple(r) for r in parity.near_pairs(df).collect())
    assert len(want) > 500
    assert sorted(tuple(r) for r in parity.near_pairs(df, most=4).collect()) == want


def test_shared_spans_over_batches():
    """Rows of one text over several batches, and what is known before the shuffle."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        k1 = np.sort(rng.integers(0, 5, n))
        rec, at = rng.integers(0, 3, n) * 2, np.arange(n, dtype=np.int32)
        kind = rng.choice([spans.PLACE, spans.PLACE, spans.WITNESS, spans.INTERVAL], n).astype(np.int8)
        cuts = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 4)]))
        columns = [k1, k1 * 3, kind, rec, at, at]
        batches = [pa.record_batch([pa.array(c[a:b]) for c in columns], names=spans._PLACES.names[:6]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        got = sorted(r["a"] for b in spans._shared(iter(batches)) for r in b.to_pylist())
        want = []
        for i in range(n):
            same = [j for j in range(n) if k1[j] == k1[i] and kind[j] != spans.INTERVAL]
            if kind[i] == spans.INTERVAL or (kind[i] == spans.PLACE and (len({rec[j] for j in same}) > 1 or any(kind[j] == spans.WITNESS for j in same))):
                want.append(i)
        assert got == want


@pytest.mark.parametrize("heavy", [0, 5, 4096])
def test_spans_of_heavy_tokens(spark, heavy):
    """The same stretches, whether spans are gathered by token or go one by one."""
    rng = random.Random(3)
    common = "".join(rng.choices("ACGT", k=150))
    rows = []
    for i in range(50):
        own = "".join(rng.choices("ACGT", k=200))
        cut = rng.randrange(0, 80)
        rows.append((i, own[:90] + (common[cut : cut + rng.randrange(50, 100)] if i % 3 else "") + own[90:]))
    rows.append((50, common * 3))
    df = spark.createDataFrame(rows, "seq_id long, sequence string")
    none = spark.createDataFrame([], "ref_id long, sequence string")
    got = sorted(tuple(r) for r in spans.shared_stretches(df, none, heavy=heavy).collect())
    holders = defaultdict(set)
    for i, s in rows:
        for j in range(len(s) - 63):
            holders[s[j : j + 64]].add(i)
    want = []
    for i, s in rows:
        covered = [any(len(holders[s[j : j + 64]]) > 1 for j in range(max(0, p - 63), min(p, len(s) - 64) + 1)) for p in range(len(s))]
        p = 0
        while p < len(s):
            if covered[p]:
                end = p
                while end < len(s) and covered[end]:
                    end += 1
                want.append((i, p, end - p))
                p = end
            p += 1
    assert got == want and len(want) > 20
