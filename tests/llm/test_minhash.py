import random
import re

import pytest
from pyspark.sql import functions as F

from hushscan.llm import minhash, shingles
from hushscan.llm.common import Scratch, components

SCHEMA = "doc_id long, text string, node string, set_id int, pivot long"


def brute(rows, words, num, den=100):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and den * common >= num * (len(a) + len(sets[j]) - common):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[y] = x
    return {r[0]: (len(s), root(r[0])) for r, s in zip(rows, sets)}


def edited(draw, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at, kind = draw.randrange(len(words)), draw.random()
        if kind < 0.6:
            words[at] = draw.choice(vocabulary)
        elif kind < 0.8:
            del words[at]
        else:
            words.insert(at, draw.choice(vocabulary))
    return words


@pytest.mark.parametrize("words, num, seed", [(3, 85, 1), (5, 80, 2), (3, 85, 3)])
def test_components_against_brute_force(spark, words, num, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for group in range(4):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([60, 120, 150]))]
        layers = [base]
        for _ in range(45):  # copies of the original and copies of copies
            layers.append(edited(draw, draw.choice(layers[: draw.choice([1, 1, 6])]), draw.randint(0, 8), vocabulary))
        rows += [" ".join(w).replace("w1", "W1") if draw.random() < 0.3 else " \n".join(w) for w in layers]
    rows += [" ".join(draw.choice(vocabulary) for _ in range(80)) for _ in range(60)]
    rows += [None, "", " \t\n", "one", "One", "one two", "one two", "é one", "É one", "x " * 20_000]
    draw.shuffle(rows)
    rows = [(7 * i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = minhash.near_duplicates(df, minhash.Similarity(words=words, num=num)).collect()
    want = brute(rows, words, num)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_nulls_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b c d e f"), (None, None)]
    df = spark.createDataFrame([(*r, "", 0, 0) for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == [(3, 3, True), (3, 3, True), (9, 3, False), (None, None, True), (None, None, True)]
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 3, None, None]


def test_another_text_of_a_dropped_id_stays(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (2, text), (2, other), (3, text.upper()), (3, None), (2, text)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, digest int")
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, text), (2, other), (3, None)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(df).collect() == [] and minhash.deduplicate(df).collect() == []


def test_enough_entries_a_band():
    for num in (70, 80, 85, 95):
        s = minhash.Similarity(num=num)
        assert (1 - (num / 100) ** s.rows) ** s.bands <= 1e-5


def test_both_ends_of_a_permutation_estimate_similarity():
    multipliers, offsets = minhash.Similarity(bands=200).permutations()
    a = shingles.shingle_set(" ".join(f"x{i}" for i in range(400)), 1)
    b = shingles.shingle_set(" ".join(f"x{i}" for i in range(100, 500)), 1)
    for one, other in zip(minhash.signature(a, multipliers, offsets), minhash.signature(b, multipliers, offsets)):
        assert abs((one == other).mean() - 0.6) < 0.06


@pytest.mark.parametrize("words, num", [(1, 85), (3, 80)])
def test_excerpts_in_a_bucket_of_edited_copies(spark, words, num):
    """All documents share one bucket, whose pivot is far from some members that link with each other."""
    draw = random.Random(num)
    base = [f"b{i}" for i in range(200)]
    texts = [base] + [edited(draw, base, draw.randint(0, 6), ["x", "y"]) for _ in range(40)]
    for share in (30, 46, 52, 60):  # less than half of the pivot, and just more
        texts += [base[: 2 * share], base[: 2 * share - 10], base[-2 * share :], base[10 - 2 * share :]]
    for group in range(6):  # families beside it, and documents with a common start only
        other = [f"g{group}w{i}" for i in range(100)]
        texts += [other] + [edited(draw, other, 3, ["x", "y"]) for _ in range(group)]
        texts += [base[:30] + [f"d{group}u{i}" for i in range(50)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    similarity = minhash.Similarity(words=words, num=num)
    signed = minhash._signed(df, similarity).withColumn("bands", F.array(F.lit(1).cast("long")))
    scratch = Scratch(spark)
    labels = components(minhash._links(df, signed, similarity, scratch), scratch).collect()
    found, sets = {r.node: r.component for r in labels}, sorted((r.doc_id, bytes(r.set_id)) for r in signed.collect())
    first = {s: i for i, s in reversed(sets)}  # equal sets are one node
    got = {i: found.get(first[s], first[s]) for i, s in sets}
    assert got == {i: c for i, (_, c) in brute(rows, words, num).items()}
