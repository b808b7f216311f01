"""Problems 1 to 5 on small tables against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kmerframe.llm import components, frequency, neighbours, parity, spans

READS = "seq_id long, sequence string, token string, w int, n int"


def reads_table(spark, rows):
    """Reads with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, s, "x", 7, None) for i, s in rows], READS)


def fold(s):
    return s.upper().replace("U", "T")


def windows(s, w):
    f = fold(s)
    return [(i, f[i : i + w]) for i in range(len(f) - w + 1) if set(f[i : i + w]) <= set("ACGT")]


def once(rows):
    best = {}
    for i, s in rows:
        if i is not None and s is not None:
            best[i] = min(s, best.get(i, s))
    return best


@pytest.fixture(scope="module")
def sample():
    """Reads with shared stretches, near copies, exact copies in other spelling, repeats, low complexity, odd symbols, nulls."""
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choices("ACGT", (7, 3, 3, 7), k=n))
    repeat = dna(90)
    rows = [(i, dna(rng.randrange(60, 400))) for i in range(1, 60)]
    for i in range(60, 120):
        s = list(rng.choice(rows[:50])[1])
        for _ in range(rng.randrange(0, 12)):
            s[rng.randrange(len(s))] = rng.choice("ACGTN-")
        cut = rng.randrange(len(s))
        rows.append((i, "".join(s[cut:] + s[:cut]) if rng.random() < 0.3 else "".join(s)))
    rows += [(i, dna(40) + repeat + dna(40)) for i in range(120, 150)]
    rows += [(150, rows[0][1].lower()), (151, rows[0][1].replace("T", "U")), (152, rows[0][1])]
    rows += [(153, "ACGT" * 60), (154, "ACGT" * 61), (155, "A" * 300), (156, "A" * 250), (157, ""), (158, None), (None, "ACGTACGTACGTA"), (159, "ACGTACGTACGT"), (160, "ACGTACGTACGT\r"), (161, "MAATQQ"), (162, "ACG")]
    rows += [(163, dna(13)), (164, "é" + dna(200)), (1, rows[0][1]), (2, rows[1][1])]
    rows.append((165, rows[-4][1][:100] + dna(5) + rows[-4][1][100:]))
    return rows


@pytest.mark.parametrize("w", [12])
def test_near_reads(spark, sample, w):
    sets = {i: {x for _, x in windows(s, w)} for i, s in once(sample).items()}
    want = set()
    for a in sets:
        for b in sets:
            if a < b and (x := len(sets[a] & sets[b])) and x * 10 >= len(sets[a] | sets[b]) * 7:
                want.add((a, b))
    got = [tuple(r) for r in parity.near_pairs(reads_table(spark, sample)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    links = {r.seq_id: (r.class_id, r.links) for r in parity.near_links(reads_table(spark, sample)).collect()}
    assert set(links) == {i for i, x in sets.items() if x}
    assert links[150][0] == links[151][0] == links[152][0] == 1
    assert parity.near_pairs(reads_table(spark, [])).count() == 0


def test_near_reads_of_all_sizes():
    """The prefixes of near sets share a key, also for tiny sets and heavily shared tokens."""
    rng = np.random.default_rng(0)
    for trial in range(300):
        n = int(rng.integers(1, 60))
        a = rng.choice(200 if trial % 3 else 10**7, n, replace=False)
        drop = rng.random(n) > rng.random() * 0.3
        b = np.unique(np.concatenate([a[drop], rng.choice(10**7, int(rng.integers(0, 4)))]))
        a = np.unique(a)
        near = len(np.intersect1d(a, b)) * 10 >= len(np.union1d(a, b)) * 7
        rarity = lambda t: (t % 40).astype(np.int64)
        row = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        token = np.concatenate([a, b]).astype(np.int64)
        if near and len(b):
            r, key, own = parity.segment_keys(row, token, rarity(token))
            shared = set(key[(r == 0)]) & set(key[r == 1])
            assert shared
            assert any(own[(r == 0) & (key == k)].any() or own[(r == 1) & (key == k)].any() for k in shared)


def test_sketch_bounds_difference():
    import pyarrow as pa

    rng = random.Random(1)
    s = "".join(rng.choices("ACGT", k=300))
    t = s[:150] + "A" + s[151:]
    batch = pa.record_batch([pa.array([1, 2]), pa.array([s, t])], names=["a", "s"])
    rows = next(iter(parity._sketches(iter([batch]), 12))).to_pylist()
    differ = sum(bin((rows[0][f"b{i}"] ^ rows[1][f"b{i}"]) & (2**64 - 1)).count("1") for i in range(parity.SKETCH_WORDS))
    assert differ <= len({x for _, x in windows(s, 12)} ^ {x for _, x in windows(t, 12)})


def test_term_marks(spark, sample):
    occurrences, holders = Counter(), defaultdict(set)
    reads = once(sample)
    for i, s in reads.items():
        for _, x in windows(s, 10):
            holders[x].add(i)
        occurrences.update(x for _, x in windows(s, 16))
    some = sorted(occurrences)[:40]
    kmers = [(x, occurrences[x]) for x in some[:20]] + [(x, occurrences[x] + 1) for x in some[20:30]] + [(some[0], occurrences[some[0]]), (some[1], 99), (some[2].replace("T", "U").lower(), None), (some[3].lower(), 77)]
    kmers += [("N" * 16, 3), ("N" * 16, 0), ("ACG", 2), (None, 4), ("ACGTACGTACGTACGTA", 1), ("", 1)]
    table = spark.createDataFrame([(k, w, "m") for k, w in kmers], "kmer string, weight long, term string")
    want = {(x, "rare") for x, h in holders.items() if len(h) == 1} | {(x, "common") for x, h in holders.items() if len(h) > 1 and len(h) * 20 >= len(reads)}
    want |= {(fold(k), "miscounted") for k, w in kmers if k is not None and w is not None and occurrences[fold(k)] != w}
    got = [tuple(r) for r in frequency.marked_terms(reads_table(spark, sample), table).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(m == "common" for _, m in want)
    assert frequency.marked_terms(reads_table(spark, []), table.limit(0)).count() == 0


def test_runs_longer_than_a_batch():
    import pyarrow as pa

    schema = pa.schema([("w", pa.int32()), ("span", pa.int32()), ("term", pa.int64()), ("occurrences", pa.int64()), ("records", pa.int64()), ("weight", pa.int64())])
    parts = [pa.record_batch([pa.array([10] * 3, pa.int32()), pa.array([0] * 3, pa.int32()), pa.array(t, pa.int64()), pa.array([1, 2, 3]), pa.array([1, 1, 1]), pa.array([None, 5, 4], pa.int64())], schema=schema) for t in ([1, 1, 2], [2, 2, 2], [2, 3, 3])]
    rows = [r for b in frequency._merged(iter(parts)) for r in b.to_pylist()]
    assert [(r["term"], r["occurrences"], r["records"]) for r in rows] == [(1, 3, 2), (2, 10, 5), (3, 5, 2)]


def test_shared_stretches(spark, sample):
    refs = [(1, sample[5][1][:80]), (2, "ACGT"), (3, None), (None, "A" * 70), (1, sample[5][1][:80])]
    holders = defaultdict(set)
    reads = once(sample)
    for i, s in reads.items():
        for _, x in windows(s, 64):
            holders[x].add(i)
    for i, s in refs:
        if i is not None and s is not None:
            for _, x in windows(s, 64):
                holders[x].add(("ref", i))
    want = set()
    for i, s in reads.items():
        marked = sorted({p for o, x in windows(s, 64) if len(holders[x]) > 1 for p in range(o, o + 64)})
        for k, p in enumerate(marked):
            if k == 0 or marked[k - 1] != p - 1:
                start = p
            if k + 1 == len(marked) or marked[k + 1] != p + 1:
                want.add((i, start, p - start + 1))
    table = spark.createDataFrame(refs, "ref_id long, sequence string")
    got = [tuple(r) for r in spans.shared_stretches(reads_table(spark, sample), table).select("seq_id", "off", "len").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    assert spans.shared_stretches(reads_table(spark, []), table.limit(0)).count() == 0


def test_compact_windows_cover_each_span_once():
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    rng.shuffle(key)
    span = 41
    left, c, right = spans.compact_windows(key, np.array([0, 100]), np.array([99, len(key) - 1]), span)
    covered = Counter()
    for lo, mid, hi in zip(left, c, right, strict=True):
        for i in range(max(lo, mid - span + 1), min(mid, hi - span + 1) + 1):
            covered[i] += 1
            assert key[i : i + span].argmin() + i == mid
    assert covered == Counter([*range(0, 60), *range(100, len(key) - span + 1)])


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("levels", [0, 2, 50])
def test_components(spark, levels):
    rng = random.Random(7)
    ids = rng.sample(range(-500, 5000), 700)
    chain = list(zip(ids[:80], ids[1:81], strict=True))
    hub = [(ids[100], x) for x in ids[101:220]]
    mixed = [tuple(rng.sample(ids[220:], 2)) for _ in range(250)]
    edges = [e for e in chain + hub + mixed if e[0] != e[1]]
    rows = [(a, b, 250.0) if rng.random() < 0.5 else (b, a, 200.0) for a, b in edges + hub[:30]]
    rows += [(1, 1, 900.0), (2, None, 900.0), (None, 3, 900.0), (ids[0], ids[300], 199.9), (ids[0], ids[301], None), (ids[0], ids[302], float("nan"))]
    table = spark.createDataFrame([(*r, 1) for r in rows], "gd_lo long, gd_hi long, norm_score double, v int")
    got = components.components(components.strong_links(table), "gd_lo", "gd_hi", levels).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.group_id for r in got} == union_find(edges)
    assert components.components(table.limit(0), "gd_lo", "gd_hi").count() == 0


def brute_pairs(rows, ks):
    best = {}
    for i, c, e, t in rows:
        if i is None or c not in ks or e is None or len(e) != 64 or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        if i not in best or t < best[i][2]:
            best[i] = (c, np.array(e, np.float32).astype(float), t)
    pairs = set()
    for c, k in ks.items():
        ids = sorted(i for i, v in best.items() if v[0] == c)
        if not ids:
            continue
        x = np.stack([best[i][1] for i in ids])
        x /= np.sqrt((x * x).sum(1))[:, None]
        for j, i in enumerate(ids):
            sims = np.round(x @ x[j], 12)
            sims[j] = -9
            for b in np.argsort(-sims, kind="stable")[: min(k, len(ids) - 1)]:
                pairs.add((min(i, ids[b]), max(i, ids[b])))
    return pairs


@pytest.mark.parametrize("copies", [0, 150])
def test_neighbours(spark, copies):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((25, 64))
    rows = []
    for i in range(700):
        rows.append((i + 1, 1 + i % 2, (centres[rng.integers(0, 25)] + 0.3 * rng.standard_normal(64)).astype(np.float32).tolist(), i))
    rows += [(2000 + i, 1, rows[10][2], i) for i in range(copies)]
    rows += [(5000, 1, None, 1), (5001, 1, [0.0] * 64, 1), (5002, 1, [1.0] * 48, 1), (5003, 9, [1.0] * 64, 1), (None, 1, [1.0] * 64, 1), (5004, 1, [float("nan")] * 64, 1), (5005, 3, [1.0] * 64, 1), (5006, 1, [None] + [1.0] * 63, 1), (5007, None, [1.0] * 64, 1)]
    rows += [(r[0], r[1], r[2], r[3] + 1000) for r in rows[:40]]
    schema = "vec_id long, config_id int, embedding array<float>, embedded_at int, k int, v string, cell int"
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema)
    configs = spark.createDataFrame([(1, 5), (2, 3), (3, 4), (4, 2), (None, 3), (6, None)], "config_id int, knn_top_k int")
    want = brute_pairs(rows, {1: 5, 2: 3, 3: 4, 4: 2})
    got = [tuple(r) for r in neighbours.nearest_pairs(table, configs).collect()]
    assert len(got) == len(set(got))
    assert len(want & set(got)) / len(want) > 0.97 and len(want & set(got)) / len(got) > 0.97
    if copies:  # ties of equal vectors go to the smaller ids
        inside = {(a, b) for a, b in want if (a == 11 or a >= 2000) and b >= 2000}
        assert inside and inside <= set(got)
    ranks = neighbours.nearest(table, configs).groupBy("vec_id").count().collect()
    assert max(r["count"] for r in ranks) == 5
    assert neighbours.nearest_pairs(table.limit(0), configs).count() == 0


def test_long_reads(spark):
    """Reads far longer than a batch, alike but for edits and a moved piece."""
    rng = random.Random(9)
    s = "".join(rng.choices("ACGT", k=150_000))
    t = s[70_000:] + "N" + s[:70_000]
    rows = [(1, s), (2, t), (3, "".join(rng.choices("ACGT", k=120_000)))]
    table = reads_table(spark, rows)
    assert [tuple(r) for r in parity.near_pairs(table).collect()] == [(1, 2)]
    got = {(r.seq_id, r.off, r.len) for r in spans.shared_stretches(table, spark.createDataFrame([], "ref_id long, sequence string")).collect()}
    assert got == {(1, 0, 150_000), (2, 0, 80_000), (2, 80_001, 70_000)}
    counts = frequency.term_counts(table, (10,)).agg({"occurrences": "sum", "records": "max"}).first()
    assert counts["sum(occurrences)"] == sum(len(windows(x, 10)) for _, x in rows) and counts["max(records)"] == 3
