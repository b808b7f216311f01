import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerframe.functions import alignment
from kmerframe.functions import sequences as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_windows(spark):
    got = one(spark, S.kmers(F.col("s"), 4), s="ACGUACGUACGUACGUACGU")
    assert len(got) == 17 and {x: got.count(x) for x in got} == {"ACGU": 5, "CGUA": 4, "GUAC": 4, "UACG": 4}
    assert one(spark, S.kmers(F.col("s"), 4), s="ACG") == [] and one(spark, S.kmers(F.lit(None).cast("string"), 4)) == []
    assert one(spark, F.size(S.kmers(F.repeat(F.lit("ACGT"), 4096), 4))) == 16381


def test_slices_and_one_hot(spark):
    assert one(spark, S.symbol_slice(F.lit("ACGTACGT"), 2, 4)) == "GTA"
    assert one(spark, S.one_hot_positions(F.lit("ACGTN.-ax"))) == [0, 1, 2, 3, 14, 15, 15, -1, -1]
    assert one(spark, S.one_hot_positions(F.lit("U"), S.ONE_HOT_RNA)) == [3]
    code = one(spark, S.one_hot(F.lit("AC-a")))
    assert len(code) == 64 and sum(code) == 3 and code[0] == code[17] == code[47] == 1
    assert one(spark, S.one_hot_decoded(F.array(*map(F.lit, code)))) == "AC-?"
    assert one(spark, S.one_hot_decoded(S.one_hot(F.lit("")))) == ""
    assert one(spark, S.transposed(F.array(*map(F.lit, range(6))), 2, 3)) == [0, 3, 1, 4, 2, 5]


def test_places(spark):
    for seq, off in ((0, 0), (0, 65535), (65535, 0), (65535, 65535)):
        packed = one(spark, S.packed_place(F.lit(seq).cast("long"), F.lit(off)))
        assert one(spark, S.unpacked_place(F.lit(packed).cast("long"))) == (seq, off)
    assert one(spark, S.packed_place(F.lit(65535).cast("long"), F.lit(65535))) == 4294967295


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, S.normalised(v)) == pytest.approx([0.6, 0.8])
    assert one(spark, S.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
    assert one(spark, S.cosine(v, F.array(F.lit(4.0), F.lit(3.0)))) == pytest.approx(0.96)
    assert one(spark, S.cosine(v, F.array(F.lit(0.0), F.lit(0.0)))) is None
    for y, d, want in ((1, 0.1, 0.0225), (1, 0.5, 0), (0, 0.5, 0.25)):
        assert one(spark, S.contrastive_term(F.lit(y), F.lit(d))) == pytest.approx(want)


def test_names_mutations_prefix(spark):
    assert one(spark, S.symbol_name(F.lit("R"))) == "A or G" and one(spark, S.symbol_name(F.lit("!"))) is None
    assert one(spark, S.mutated(F.lit("ACGT"), F.lit(1), F.lit(2))) == "ATGT"
    assert one(spark, S.common_prefix(F.lit("ACGC"), F.lit("ACGT"))) == 3
    assert one(spark, S.common_prefix(F.lit(""), F.lit("ACGT"))) == 0


def naive(a, b, matrix, opened, extended):
    n, m = len(a), len(b)
    sign = alignment.MATRIX_SYMBOLS.index
    h, e, f = (np.zeros((n + 1, m + 1)) for _ in range(3))
    e[:], f[:] = -1e9, -1e9
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i, j] = max(e[i - 1, j] - extended, h[i - 1, j] - opened)
            f[i, j] = max(f[i, j - 1] - extended, h[i, j - 1] - opened)
            h[i, j] = max(0, h[i - 1, j - 1] + matrix[sign(a[i - 1]), sign(b[j - 1])], e[i, j], f[i, j])
    return int(h.max())


def test_alignment():
    assert (alignment.NUC44 == alignment.NUC44.T).all()
    goldens = [("ACGTACGT", "ACGTACGT", 40), ("AAAA", "TTTT", 0), ("ACGTTACGGT", "ACGTACGGT", 42), ("ACGTAACCGGTT", "ACGTAGGTT", 40)]
    assert alignment.scores([a for a, _, _ in goldens], [b for _, b, _ in goldens]).tolist() == [s for _, _, s in goldens]
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ACGTNRY"), rng.integers(0, 30))) for _ in range(60)]
    for opened, extended, matrix in ((3, 1, alignment.NUC44), (5, 2, alignment.simple_matrix(2, -3))):
        got = alignment.scores(texts, texts[::-1], matrix, opened, extended)
        assert got.tolist() == [naive(a, b, matrix, opened, extended) for a, b in zip(texts, texts[::-1], strict=True)]
        assert got.tolist() == alignment.scores(texts[::-1], texts, matrix, opened, extended).tolist()
    s = "".join(rng.choice(list("ACGT"), 64))
    assert alignment.scores([s, s], [s, s[3:] + s[:3]])[0] == 320 and alignment.scores([s], [s[3:] + s[:3]])[0] >= 305
    assert alignment.concordance("ACGTTACGGT", "ACGTACGGT", 10) == 0.9
    assert alignment.scores(["acgu"], ["ACGT"]).tolist() == [20] and alignment.scores([], []).tolist() == []


def test_alignment_of_tables(spark):
    df = spark.createDataFrame([(1, "ACGT", "ACGT"), (2, None, "A"), (3, "A" * 300, "A" * 700)], "id int, a string, b string")
    assert {r.id: r.score for r in alignment.with_scores(df, "a", "b").collect()} == {1: 20, 2: 0, 3: 1500}
    assert alignment.with_scores(df.limit(0), "a", "b").count() == 0
