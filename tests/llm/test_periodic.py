"""Periodic runs against a search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from hushscan.llm import periodic
from hushscan.llm.periodic import Repetition

ROWS = "doc_id bigint, text string, runs string, n_words int, extra int"


def brute(words, times=4, least=6):
    """Every maximal stretch of every period; the smallest period names it."""
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, times * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def texts():
    draw = random.Random(3)
    out = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x " + "a b c\n" * 9 + "y", "é  " * 8, "ß SS " * 40]
    out += ["b a " * 5 + "a " * 9 + "c a b " * 6, "long " * 30_000, " ".join(f"w{i % 4000}" for i in range(20_000))]
    for _ in range(150):
        words = [draw.choice("ab") if draw.random() < 0.7 else draw.choice("cdefg") for _ in range(draw.randint(0, 60))]
        if words and draw.random() < 0.6:
            a, p = draw.randrange(len(words)), draw.randint(1, 12)
            words = [words[i] if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i in range(len(words))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("rule", [Repetition(), Repetition(2, 2), Repetition(3, 5), Repetition(4, 20)])
def test_runs_against_all_periods(rule):
    draw = random.Random(rule.times * 100 + rule.least)
    for _ in range(400):
        size = draw.choice((1, 2, 3, 6))
        ids = [draw.randrange(size) for _ in range(draw.randint(0, 70))]
        if ids and draw.random() < 0.6:
            a, p = draw.randrange(len(ids)), draw.randint(1, 15)
            ids = [ids[i] if i < a else ids[a + (i - a) % p] for i in range(len(ids))] if a + p <= len(ids) else ids
        got = periodic.find_runs(np.array(ids, np.int64), rule)
        assert got == brute(ids, rule.times, rule.least), ids


def test_operator(spark):
    given = texts()
    rows = [(i, t, "mine", 7, 1) for i, t in enumerate(given)] + [(None, "z " * 7, None, None, None), (3, "a", "again", 0, 0)]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    got = periodic.periodic_runs(df)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    result = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str)
    want = []
    for i, text, *_ in rows:
        words = words_of(text)
        runs = brute(words) if len(words) < 5000 else None
        if runs is None:  # the two long ones by hand
            runs = [(0, 30_000, 1)] if words[0] == "long" else [(0, 20_000, 4000)]
        want.append((i, len(words), runs, collapse(words, runs)))
    assert result == sorted(want, key=str)


def test_digests_and_loops_by_the_contract(spark):
    given = texts() * 2
    rows = [(i - 40, t) for i, t in enumerate(given)] + [(None, "q " * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in periodic.digests(periodic.periodic_runs(periodic.looped(df))).collect()}
    looped = 0
    for doc_id, text in rows:
        words = words_of(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            looped += 1
        if n > 5000:
            continue
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        front = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[doc_id] == (len(runs), *front, sha(lines), sha(collapse(words, runs))), (doc_id, words)
    assert looped > 10


def test_strongest_breaks_ties(spark):
    runs = [(5, 8, 2), (1, 4, 1), (1, 8, 2), (0, 6, 2)]
    df = spark.createDataFrame([(1, runs), (2, [])], f"doc_id bigint, runs array<{periodic.RUN}>")
    got = {r.doc_id: r.best and tuple(r.best) for r in df.select("doc_id", periodic.strongest().alias("best")).collect()}
    assert got == {1: (1, 4, 1), 2: None}


def test_empty_table_and_clash(spark):
    df = spark.createDataFrame([], ROWS)
    assert periodic.digests(periodic.periodic_runs(periodic.looped(df))).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, keep=("doc_id", "runs"))
    with pytest.raises(ValueError):
        Repetition(1, 6)
