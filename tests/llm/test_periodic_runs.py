"""Runs of words against brute force over all periods, and the cases of empty, null, long and repeated texts."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cohortmart.llm import periodic_runs
from tests.conftest import rows


def plain_runs(w):
    """(start, length, period) by comparing every word with that of every period."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(w):
    gone = {i for s, n, q in plain_runs(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made(rnd):
    letters = rnd.choice([1, 2, 2, 3, 5, 50, 1000])
    w = [str(rnd.randrange(letters)) for _ in range(rnd.choice([0, 1, 5, 24, 60, 200, 400]))]
    for _ in range(rnd.randrange(4)):
        p = [str(rnd.randrange(letters)) for _ in range(rnd.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 21, 40]))]
        at = rnd.randrange(len(w) + 1)
        w[at:at] = (p * rnd.randrange(1, 8))[: max(1, len(p) * 5 - rnd.randrange(len(p)))]
    return w


def test_runs_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        texts = [made(rnd) for _ in range(rnd.choice([1, 2, 20]))]
        texts += texts[:3]
        for w, (runs, n, collapsed) in zip(texts, periodic_runs.runs_of_texts([" ".join(w) for w in texts]), strict=True):
            assert (runs, n, collapsed) == (plain_runs(w), len(w), plain_collapsed(w))


def test_periods_whose_stretches_come_twice_in_them():
    """Every stretch of 16 words comes twice within the period, so its next place is nearer than a period."""
    a = [f"a{k}" for k in range(40)]
    period = (a + ["b"]) * 2 + (a + ["c"]) * 2
    for times in (3, 4):
        w = ["x"] + period * times + ["y"]
        assert list(periodic_runs.runs_of_texts([" ".join(w)]))[0][0] == plain_runs(w)


def test_words_like_fibonacci_and_thue_morse():
    a, b = "a", "ab"
    while len(b) < 2000:
        a, b = b, b + a
    morse = [str(bin(i).count("1") & 1) for i in range(1024)] * 3
    for w in (list(b), morse, ["a"] * 3000):
        assert list(periodic_runs.runs_of_texts([" ".join(w)]))[0][0] == plain_runs(w)


def test_grammar_derives_the_words():
    rnd = random.Random(7)
    ids = np.array([rnd.randrange(3) for _ in range(500)] * 2)
    own = np.repeat([0, 1], 500)
    spans = {}
    for symbol, start, middle, end, text in periodic_runs._rules(ids.copy(), own):
        for s, a, m, b, t in zip(symbol, start, middle, end, text, strict=True):
            assert a < m < b and own[a] == own[b - 1] == t
            assert spans.setdefault(int(s), tuple(ids[a:b])) == tuple(ids[a:b])


def test_other_hashes_when_the_first_fail(monkeypatch):
    w = ["u", "v"] * 20 + ["w"] * 5
    monkeypatch.setattr(periodic_runs._Compare, "_equal", lambda self, i, j, size, was=periodic_runs._Compare._equal: was(self, i, j, size) if len(bases) > 1 else np.ones(len(i), bool))
    bases = []
    start = periodic_runs._Compare.__init__
    monkeypatch.setattr(periodic_runs._Compare, "__init__", lambda self, ids, b: (bases.append(b), start(self, ids, b))[1])
    assert list(periodic_runs.runs_of_texts([" ".join(w)]))[0][0] == plain_runs(w) and len(bases) == 2


def test_edge_cases(spark):
    texts = [None, "", " \n\t ", "one", "a " * 23, "a " * 24, "a\x0bb\x0c" * 12, "\u00e4\u00a0\u00df " * 30, "a b c " * 5000 + "end", "a b c " * 5000 + "end", "\x1c " * 24]
    docs = spark.createDataFrame([(k, t, "x", 1.5, "y") for k, t in enumerate(texts)], "doc_id long, text string, runs string, period double, given_text string")
    got = {r["doc_id"]: r for r in periodic_runs.repeated_runs(docs).collect()}
    assert len(got) == len(texts) and set(got[0].asDict()) == {"doc_id", "period", "given_text", "n_words", "runs", "collapsed"}
    assert [got[k]["n_words"] for k in range(8)] == [0, 0, 0, 1, 23, 24, 24, 30] and [len(got[k]["runs"]) for k in range(11)] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1]
    assert tuple(got[6]["runs"][0]) == (0, 24, 2) and got[6]["collapsed"] == "a b" and got[8]["collapsed"] == got[9]["collapsed"] == "a b c end"
    assert periodic_runs.repeated_runs(docs.limit(0)).count() == 0


def test_query_on_a_small_table(spark, tmp_path):
    texts = {k: " ".join(made(random.Random(k))) for k in range(60)} | {60: None, 61: ""}
    spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, t in texts.items():
        w, h = (t or "").split(), zlib.crc32(str(k).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((k, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(w).encode()).hexdigest()))
    got = periodic_runs.query(spark, str(tmp_path))
    assert rows(got) == sorted(want, key=repr) and any(x[1] for x in want)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where(F.col("n_runs").isNull()).count() == 0
