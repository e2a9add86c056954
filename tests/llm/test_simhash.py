"""Fingerprints: the order of edits, and near fingerprints against all pairs."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from hushscan.llm import simhash
from hushscan.llm.simhash import Near, edit, print_of

SCHEMA = "doc_id bigint, text string, fingerprint string, class_id int"


def differ(a, b):
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b))


def hexed(p):
    return "".join(f"{w & (1 << 64) - 1:016x}" for w in p)


def corpus():
    draw = random.Random(8)
    words = [f"wort{i}" for i in range(400)]
    out = []
    for i in range(160):
        text = " ".join(draw.choices(words, k=draw.randint(1, 200)))
        out.append((3 * i - 50, text))
        if i % 5 == 0:
            out.append((1000 + i, text))
        if i % 3 == 0:
            said = text.split()
            said[draw.randrange(len(said))] = "changed"
            out.append((2000 + i, " ".join(said)))
    return out + [(9001, None), (9002, ""), (9003, " \n"), (9004, "ein \U0001f600 wort" * 3), (9005, "lang " * 60_000), (9006, "x")]


def expected(rows):
    """The chain by descending id, and all pairs of fingerprints."""
    chain = sorted(rows, key=lambda r: -r[0])
    prints = {i: print_of(t) for i, t in rows}
    out = {}
    for at, (i, text) in enumerate(chain):
        after, following = chain[(at + 1) % len(chain)]
        changed = edit(text or "", following or "")
        out[i] = (
            len(text or ""),
            hashlib.sha256(changed.encode()).hexdigest(),
            hexed(prints[i]),
            hexed(print_of(changed)),
            1 - differ(prints[i], print_of(changed)) / 128,
            1 - differ(prints[i], prints[after]) / 128,
            min(j for j in prints if prints[j] == prints[i]),
            sum(differ(prints[i], prints[j]) <= 3 for j in prints) - 1,
        )
    return out


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_edits_in_order(spark, buckets):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(6)
    want = expected(rows)
    got = simhash.edited_prints(df, buckets).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256, hexed(r.fingerprint), hexed(r.edited)) == want[r.doc_id][:4]


@pytest.mark.parametrize("tile", [simhash.TILE, 3])
def test_documents_near(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(6)
    got = {r.doc_id: tuple(r)[1:] for r in simhash.documents_near(df).collect()}
    assert got == expected(rows)
    assert any(v[-1] for v in got.values())


@pytest.mark.parametrize("near", [Near(0, 1), Near(3, 4), Near(3, 5), Near(6, 8), Near(8, 9)])
@pytest.mark.parametrize("tile", [simhash.TILE, 5])
def test_near_counts_against_all_pairs(spark, monkeypatch, near, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = random.Random(near.radius)
    prints = {}
    for _ in range(6):
        base = draw.getrandbits(128)
        for _ in range(25):
            bits = base
            for b in draw.sample(range(128), draw.randint(0, 9)):
                bits ^= 1 << b
            prints[bits] = draw.randint(1, 4)
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    rows = [(signed(p >> 64), signed(p & (1 << 64) - 1), size) for p, size in prints.items()]
    df = spark.createDataFrame(rows, "hi bigint, lo bigint, size bigint").repartition(3)
    got = {(r.hi, r.lo): r.others for r in simhash.near_counts(df, near).collect()}
    want = {}
    for hi, lo, _ in rows:
        others = sum(s for h, l, s in rows if (h, l) != (hi, lo) and differ((hi, lo), (h, l)) <= near.radius)
        if others:
            want[hi, lo] = others
    assert got == want


def test_masks_cover_all_choices():
    for near in (Near(3, 4), Near(3, 6), Near(2, 3)):
        masks = near.masks()
        draw = np.random.default_rng(1)
        for _ in range(200):
            flips = draw.choice(128, near.radius, replace=False)
            hi = sum(1 << int(b - 64) for b in flips if b >= 64)
            lo = sum(1 << int(b) for b in flips if b < 64)
            assert any(not (int(m[0]) & hi or int(m[1]) & lo) for m in masks)
    with pytest.raises(ValueError):
        Near(3, 3)


def test_repeated_and_null_ids(spark):
    """Rows of one id follow by hash of the text; one id may fill most of the table."""
    rows = [(7, f"text {i} " * (1 + i % 5)) for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, f"other {i}") for i in range(20)] + [(9, "same")] * 50
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(4)
    for buckets in (1, 12):
        got = simhash.edited_prints(df, buckets).collect()
        assert sorted((str(r.doc_id), r.n_chars, hexed(r.fingerprint)) for r in got) == sorted((str(i), len(t), hexed(print_of(t))) for i, t in rows)
        digests = sorted((str(r.doc_id), r.edited_sha256) for r in got)
        first = digests if buckets == 1 else first
        assert digests == first


def test_equal_texts_and_words(spark):
    assert print_of("Ab  c") == print_of("aB\tc") != print_of("c ab")
    assert print_of(None) == print_of("") == print_of("\n") == (0, 0)
    long = " ".join(f"w{i}" for i in range(50_000))
    assert print_of(long) == print_of(long) and differ(print_of(long), print_of(long + " more")) < 8


def test_any_columns(spark):
    df = spark.createDataFrame([(1, "a b", "old", 4)], SCHEMA)
    got = simhash.fingerprints(df)
    assert got.columns == ["doc_id", "text", "class_id", "fingerprint"]
    assert tuple(got.first().fingerprint) == print_of("a b")
    assert tuple(simhash.fingerprints(df, name="text").first()["text"]) == print_of("a b")


def test_one_and_no_document(spark):
    df = spark.createDataFrame([(5, "ein satz mit worten", "", 0)], SCHEMA)
    row = simhash.documents_near(df).first()
    assert row.near_next == 1 and row.n_near == 0 and row.class_id == 5
    assert simhash.documents_near(df.where("doc_id < 0")).count() == 0
