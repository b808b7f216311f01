"""Problems 6 to 8 on small tables."""

import os
import random

import pytest

from kmerframe.llm import mixing, residue, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="the vocabulary is not here")


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, source if isinstance(source, str) else source[i], 1, "x", [5]) for i, t in enumerate(texts)], "doc_id long, text string, source string, tokens int, row string, ids array<int>")


TEXTS = ["", None, " ", "\n\n  \t", "Hello world", "don't we'll re 'RE 123 <|endoftext|>", "naïve 日本語 🙂🙂", "a" * 5000, " " * 3000 + "x", "ab " * 2000, "x\r\n\r\ny z"]


@needs_vocabulary
def test_ids(spark):
    enc = tokens.encoding(tokens.DEFAULT_VOCABULARY)
    want = [enc.encode_ordinary(t) if t else [] for t in TEXTS]
    for limits in ({}, {"long_chars": 300, "piece_chars": 64}, {"long_chars": 40, "piece_chars": 16}):
        df = documents(spark, TEXTS + [TEXTS[7]])
        got = tokens.encoded(df.unionByName(df.where("doc_id = 7")), **limits).collect()
        assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((i, tuple(w)) for i, w in [*enumerate(want), (len(TEXTS), want[7]), (7, want[7])])
    assert all(enc.decode(w) == (t or "") for w, t in zip(want, TEXTS, strict=True))
    assert tokens.encoded(documents(spark, [])).count() == 0


@needs_vocabulary
def test_joined_at_any_place():
    enc = tokens.encoding(tokens.DEFAULT_VOCABULARY)
    rng = random.Random(11)
    parts = ["a", "b", " ", "  ", "\n", "'", "r", "e", "1", "é", "日", "🙂", "!!", "the", " lowest", "'ll", "l", "\t", "_", "zzzz"]
    for _ in range(400):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(2, 300))) if rng.random() < 0.7 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 800)))
        size = rng.choice([1, 2, 5, 40])
        pieces = [(x, tokens._ids(enc, x)) for x in (s[i : i + size] for i in range(0, len(s), size))]
        while len(pieces) > 1:
            pieces = [tokens.joined(pieces[i], pieces[i + 1], enc, rng.choice([2, 8])) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        assert pieces[0][1].tolist() == enc.encode_ordinary(s)


def test_water_fill():
    assert mixing.water_fill(100, {"a": 0.5, "b": 0.5}, {"a": 1000, "b": 1000}) == {"a": 50, "b": 50}
    assert mixing.water_fill(100, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 20, "b": 1000, "c": 1000}) == {"a": 20, "b": 40, "c": 40}
    assert mixing.water_fill(100, {"a": 0.9, "b": 0.1}, {"a": 30, "b": 20}) == {"a": 30, "b": 20}
    got = mixing.water_fill(100, {"a": 0.4, "b": 0.4, "c": 0.2}, {"a": 10, "b": 44, "c": 1000})
    assert got == {"a": 10, "b": 44, "c": 46}
    assert mixing.water_fill(100, {"a": 0.5, "b": 0.5}, {"a": 0}) == {"a": 0, "b": 0} and mixing.water_fill(0, {"a": 1.0}, {"a": 5}) == {"a": 0}


@needs_vocabulary
def test_mixture(spark):
    rng = random.Random(2)
    sources = ["big"] * 900 + ["small"] * 60 + ["other"] * 30 + [None] * 10
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 60))) for _ in sources]
    texts[0], texts[1], texts[901] = None, "", "long " * 3000
    df = documents(spark, texts, sources)
    df = df.unionByName(df.where("doc_id < 20"))
    targets = spark.createDataFrame([("big", 0.5, 1, 1), ("small", 0.4, 3, 1), ("absent", 0.1, 2, 1), (None, 0.3, 1, 1), ("other", None, 1, 1), ("big", 0.5, 1, 1), ("nan", float("nan"), 1, 1)], "source string, target_share double, max_repeats int, tokens int")
    enc = tokens.encoding(tokens.DEFAULT_VOCABULARY)
    size = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    for total in (None, 2000, 10**9):
        mixed, report = mixing.mixture(df, targets, total)
        rows = mixed.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        most = {"big": 1, "small": 3}
        assert all(sources[r.doc_id] == r.source and r.tokens == size[r.doc_id] > 0 and 1 <= r.copies <= most[r.source] for r in rows)
        told = {r.source: r for r in report.collect()}
        assert set(told) == {"big", "small", "absent"} and told["absent"].mixed_tokens == 0
        assert sum(r.reached_share for r in told.values()) == pytest.approx(1)
        for s in most:
            assert told[s].mixed_tokens == sum(r.tokens * r.copies for r in rows if r.source == s)
        want = mixing.water_fill(total or sum(size), {"big": 0.5, "small": 0.4, "absent": 0.1}, {s: most[s] * sum(z for z, x in zip(size, sources, strict=True) if x == s) for s in most})
        for s in most:
            assert abs(told[s].mixed_tokens - want[s]) <= max(size[i] for i in range(len(size)) if sources[i] == s)
    assert {tuple(r) for r in mixing.mixture(df, targets, 2000)[0].collect()} == {tuple(r) for r in mixing.mixture(df, targets, 2000)[0].collect()}
    assert mixing.mixture(df.limit(0), targets)[0].count() == 0 and mixing.mixture(df, targets.limit(0))[0].count() == 0


CASES = [
    "# {{ title }}\n\nSome real text about the tide and the harbour.",
    "# Tide\n\nAuthor: @@author@@\n\nThe plot shows the tide.",
    "# Tide\n\nResults for ${student_id}, «project».\n",
    "# %% [markdown]\n# # <COURSE_NAME>\n# \n# Text of the cell.\n\n# %% [1]\nprint(1)",
    '{"cells": [{"cell_type": "markdown", "metadata": {}, "source": ["# Tide\\n", "\\n", "Date: [your date here]"]}], "nbformat": 4}',
    "In [1]:\n# YOUR CODE HERE\nraise NotImplementedError()\n\nThe tide.",
    "```python\nresult = ____  # fill in the blank\n```",
    '<cell kind="code" n="1">\n### BEGIN ANSWER\n\n### END ANSWER\n</cell>',
    "# Tide\n\nWrite your answer here.\n\n```python\nprint(1)\n```",
    "Lorem sordit placer vexa mordax orbis fugam tenebr lacunae perelis.",
    "bla bla bla bla bla bla bla bla bla bla",
    "asdf jkl sdfj lkjsd fjkl sdfkj lsdkf jlsdk",
    "# Tide\n\nBullet one: tbd\nBullet two: n/a yet\n",
    "Home | Help | Sign in\n\nAccess denied. You don't have permission to open this file.",
    "404 Not Found",
    "<html><head><title>503 Service Unavailable</title></head><body></body></html>",
    "# Tide & harbour\n\nPlease enable JavaScript in your browser to view this notebook.\n\nviewer build 3.2",
    "Veuillez activer JavaScript pour afficher ce carnet.",
]
CLEAR = [
    None, "", "  \n", "# Tide",
    "Templates with double braces are filled by the renderer, as in `{{ team }}`; see below.",
    "$\\hat{y}_{{t+1}} = \\alpha y_t$",
    "```python\nTemplate('${year} report').substitute(year=3)\nlabel = f'{author}: {value:.2f}'\n```",
    "In [1]:\nquery = 'SELECT * FROM t WHERE day = %(team)s'\nrun(query, {'team': 3})",
    "Remove rows with the placeholder value `__AUTHOR__` or `<author>` that the export tool leaves behind.",
    "```python\nclass Base:\n    def fit(self, x):\n        raise NotImplementedError\n```",
    "```python\n# YOUR CODE HERE\nanswer = solve(x)\n```",
    "```python\nwords = 'lorem ipsum velum marit'.split()\n```\n\n```text\nlorem ipsum dolor velum\n```",
    "We log each failed request (Forbidden, Too Many Requests, Bad Gateway) and plot them by hour.\n\n```python\nx = 1\n```",
    "# Map\n\nThe widget needs JavaScript to be enabled in the browser; without it you see the static figure. " + "The residuals look fine, apart from some rows around the site. " * 8,
    "The tide is high. The tide is high. The tide is high. The tide is high.",
]


def test_residue(spark):
    df = documents(spark, CASES + CLEAR)
    got = [r.doc_id for r in residue.residue(df).collect()]
    assert sorted(got) == list(range(len(CASES)))
    assert residue.residue(df.limit(0)).count() == 0
    assert residue.residue(documents(spark, ["word and some more text of the tide. " * 20000, "{" * 50000, "<" * 50000, "`" * 20001, "$" * 20001])).count() == 0


def test_broken_forms():
    assert not residue.is_residue('{"cells": [{"cell_type": "markdown", "source": ["# Tide')
    assert residue.is_residue('{"cells": [{"cell_type": "markdown", "source": ["# {{ title }}\\n", "cut off')
    assert residue.cells_of('{"cells": [null]}') and residue.cells_of('{"cells": 3}')
