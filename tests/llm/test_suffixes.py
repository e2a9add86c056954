import hashlib
import random

import numpy as np
import pytest

from hushscan.llm import suffixes

SCHEMA = "doc_id long, text string, doc string, places int, anchor long"


def brute(rows, size):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - size + 1):
            window = data[i : i + size]
            if window in seen:
                gone[i : i + size] = True
            seen.add(window)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1)
        out[doc] = (len(data), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest())
    return out


def fixture(seed, size):
    draw = random.Random(seed)
    letters = draw.choice(["ab", "abcdefgh é", "abcdefghijklmnop 😀"])
    text = lambda n: "".join(draw.choice(letters) for _ in range(n))
    shared = [text(draw.choice([size - 1, size, size + 1, 3 * size, 9 * size])) for _ in range(12)]
    rows = [None, "", "x", "a" * 3 * size, "ab" * 2 * size, text(40 * size)]
    for _ in range(60):
        rows.append("".join(draw.choice([text(draw.randint(0, 2 * size)), draw.choice(shared)]) for _ in range(draw.randint(1, 6))))
    rows += [draw.choice(rows[3:]) for _ in range(10)]
    edited = [r[: len(r) // 2] + "#" + r[len(r) // 2 :] for r in rows[5:20]]
    rows += edited
    draw.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, size", [(1, 40), (2, 24), (3, 100), (4, 33)])
def test_removed_bytes_against_brute_force(spark, seed, size):
    rows = fixture(seed, size)
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = suffixes.duplicate_bytes(df, suffixes.Depth(size)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows, size)
    assert len(got) == len(rows)


def test_blocks_of_a_long_text_meet(spark, monkeypatch):
    draw = random.Random(9)
    text = "".join(draw.choice("abcdef") for _ in range(3000))
    whole = suffixes.segments(np.frombuffer((text * 2).encode(), np.uint8), suffixes.Depth(50))
    monkeypatch.setattr(suffixes, "_BLOCK", 512)
    parts = suffixes.segments(np.frombuffer((text * 2).encode(), np.uint8), suffixes.Depth(50))
    covered = lambda s: [i for a, b in zip(s[0], s[1]) for i in range(a, b + 1)]
    assert covered(parts) == covered(whole) == list(range(6000 - 49))
    anchors = lambda s: np.repeat(s[2], s[1] - s[0] + 1)
    assert (anchors(parts) == anchors(whole)).all()


def test_cut_keeps_whole_characters(spark):
    passage = "".join(chr(256 + i) for i in range(60))
    rows = [(1, passage + "x"), (2, "yz" + passage), (3, None), (None, passage), (None, "q")]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    got = suffixes.remove_repeats(df, suffixes.Depth(100))
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(1, passage + "x"), (2, "yz"), (3, None), (None, ""), (None, "q")], key=str
    )
    assert suffixes.cut("aéb", np.array([True, True, False, True])) == "é"


def test_rows_that_repeat_an_id(spark):
    draw = random.Random(3)
    text = "".join(draw.choice("abcdefgh") for _ in range(200))
    df = spark.createDataFrame([(5, text, "", 0, 0), (5, text, "", 0, 0), (5, "--" + text, "", 0, 0)], SCHEMA)
    got = sorted((r.n_bytes, r.n_removed) for r in suffixes.duplicate_bytes(df, suffixes.Depth(100)).collect())
    assert got in ([(200, 0), (200, 0), (202, 200)], [(200, 200), (200, 200), (202, 0)])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffixes.duplicate_bytes(df).collect() == [] and suffixes.remove_repeats(df).collect() == []


def test_runs_of_the_first_pass_are_told_apart_by_64_bits(spark):
    draw = random.Random(6)
    rows = [(i, bytearray(), "".join(draw.choice("abcdefgh") for _ in range(400))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc long, text_id binary, text string")
    spanned = [r.spanned for r in suffixes._sparse(df, suffixes.Depth(100)).collect()]
    assert len(spanned) > 200 and len({s >> 40 for s in spanned}) > 0.9 * len(spanned)


def test_many_texts_of_null_and_repeated_ids(spark):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    shared = [text(60) for _ in range(20)]
    texts = [text(draw.randint(1, 90)) + draw.choice(shared) + text(draw.randint(0, 90)) for _ in range(3000)]
    rows = [((1 << 63) - 1, texts[0])] + [(None if i % 3 else 5, t) for i, t in enumerate(texts + texts[:200])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.duplicate_bytes(df, suffixes.Depth(40)).collect()
    # one document of each id and text, in the order of the ids, then of the digests, null ids last
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()))
    place = {row: i for i, row in enumerate(order)}
    want = brute([(i, t) for i, (_, t) in enumerate(order)], 40)
    said = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert said == sorted((str(r[0]), *want[place[r]]) for r in rows)
