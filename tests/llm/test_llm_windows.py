"""Packed windows against plain strings."""

import numpy as np
import pyarrow as pa

from kmerframe.llm import windows
from kmerframe.runtime import bounded


def test_packed_windows():
    s = windows.symbols(pa.array(["ACGTUacgNNtt", None, "", "éACG"]))
    at, code = s.windows(3)
    rows = s.rows(at)
    assert windows.unpacked(code, 3).to_pylist() == ["ACG", "CGT", "GTT", "TTA", "TAC", "ACG", "ACG"]
    assert rows.tolist() == [0] * 6 + [3] and (at - s.starts[rows]).tolist() == [0, 1, 2, 3, 4, 5, 1]
    long = "".join(np.random.default_rng(0).choice(list("ACGT"), 100))
    at, code = windows.symbols(pa.array([long])).windows(31)
    assert windows.unpacked(code, 31).to_pylist() == [long[i : i + 31] for i in range(70)]
    batch = pa.record_batch([pa.array(["A" * 10, None, "C" * 30, "G" * 5])], names=["s"])
    assert [b.num_rows for b in bounded(iter([batch]), 0, 12)] == [2, 1, 1]


def test_places_of_many_rows():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ACGTN"), int(n))) for n in rng.integers(0, 12, 300)]
    for column in (pa.array(texts), pa.array(["é", *texts]).slice(1), pa.chunked_array([pa.array(texts[:9]), pa.array(texts[9:])])):
        s = windows.symbols(column)
        for w in (1, 3, 7):
            at = s.places(w)
            rows = s.rows(at)
            want = [(r, i) for r, x in enumerate(texts) for i in range(len(x) - w + 1) if "N" not in x[i : i + w]]
            assert list(zip(rows.tolist(), (at - s.starts[rows]).tolist(), strict=True)) == want
