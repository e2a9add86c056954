import random

import pytest
import samples
import twin
from pyspark.sql import functions as F

from hushscan.functions import spans as S
from hushscan.functions.redaction import redact, scrub


def native(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    text = F.col("text")
    rows = df.select(
        "id",
        S.locate_spans(text, S.detect_spans(text)).alias("s"),
        redact(text).alias("r"),
    ).collect()
    return {r.id: r for r in rows}


def test_native_spans_equal_the_twin_on_random_texts(spark):
    texts = samples.fuzz(1500) + samples.fuzz(40, seed=3, longest=400)
    got = native(spark, texts)
    for i, text in enumerate(texts):
        want = [(s, e, k, *twin.region(text, s), *twin.region(text, e)) for s, e, k in twin.detect(text)]
        have = [
            (m.start, m.end, m.kind, m.line, m["column"], m.end_line, m.end_column) for m in got[i].s
        ]
        assert have == want, repr(text)
        assert all(text[m.start : m.end] == m.value for m in got[i].s)
        assert got[i].r.text == twin.redact(text)
        assert got[i].r.redacted == bool(want)


def test_each_format_is_reported_once_with_its_whole_span(spark):
    texts = [f"x ({v}) y" for _, v in samples.POSITIVE] + [f"SECRET_TOKEN={v}" for _, v in samples.POSITIVE]
    got = native(spark, texts)
    n = len(samples.POSITIVE)
    for i, (kind, value) in enumerate(samples.POSITIVE):
        assert [(m.kind, m.value) for m in got[i].s] == [(kind, value)]
        if kind not in ("aws_secret_access_key", "bearer_token", "private_key_block", "jwt"):
            assert kind in [m.kind for m in got[n + i].s]


def test_documentation_filler_is_not_reported(spark):
    got = native(spark, samples.FILLER)
    assert all(r.s == [] for r in got.values())


@pytest.mark.parametrize(
    "make, lengths",
    [
        (lambda n: "npm_" + (samples.BODY * 2)[:n], {35: 0, 36: 1, 37: 0}),
        (lambda n: "hf_" + (samples.BODY * 2)[:n], {29: 0, 30: 1, 34: 1}),
        (lambda n: "SG." + samples.BODY[:22] + "." + (samples.BODY * 2)[:n], {42: 0, 43: 1, 44: 0}),
        (
            lambda n: "https://hooks." + "slack.com/services/T0123ABCD/B0123ABCD/" + samples.BODY[:n],
            {23: 0, 24: 1, 25: 0},
        ),
    ],
)
def test_length_boundaries(spark, make, lengths):
    got = native(spark, [make(n) for n in lengths])
    for i, want in enumerate(lengths.values()):
        assert len([m for m in got[i].s if m.kind != "high_entropy"]) == want


def test_urls_hide_identifiers_but_not_logins_or_queries(spark):
    token = "K8yB1nD6fH3jC5sEaX9pQ2zM7vL0rT4w"
    texts = [
        f"https://h.io/{token}", f"www.h.io/{token}", f"https://{token}.h.io/a",
        f"https://u:{token}@h.io/", f"https://h.io/a?q={token}", f"https://h.io/a#{token}",
    ]
    got = native(spark, texts)
    assert [len(got[i].s) for i in range(6)] == [0, 0, 0, 1, 1, 1]


def test_null_empty_and_plain_texts(spark):
    got = native(spark, [None, "", "plain prose with nothing", "1" * 30, "\x00\x01"])
    assert all(r.s == [] and r.r.redacted is False for r in got.values())
    assert [got[i].r.text for i in range(3)] == [None, "", "plain prose with nothing"]


def test_a_very_long_text_with_many_spans(spark):
    rng = random.Random(1)
    parts = []
    for i in range(3000):
        parts.append("é" * rng.randint(0, 60) + "\n" * rng.randint(0, 2) + " ghp_" + samples.BODY[:30] + " ")
    text = "".join(parts)
    got = native(spark, [text])[0]
    want = [(s, e, k, *twin.region(text, s)) for s, e, k in twin.detect(text)]
    assert [(m.start, m.end, m.kind, m.line, m["column"]) for m in got.s] == want
    assert len(want) == 3000
    assert got.r.text == twin.redact(text)


def test_random_span_sets_merge_like_the_twin(spark):
    rng = random.Random(5)
    sets = []
    for _ in range(400):
        spans = set()
        for _ in range(rng.randint(0, 25)):
            a = rng.randint(0, 60)
            spans.add((a, a + rng.randint(1, 30), rng.randint(0, 19)))
        sets.append([(a, a - b, r, str(r), "v") for a, b, r in spans])
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], f"id int, s array<{S.SPAN}>")
    got = {r.id: r.m for r in df.select("id", S.merge_spans(F.col("s")).alias("m")).collect()}
    for i, spans in enumerate(sets):
        want = twin.merged([(a, a - n, r, k) for a, n, r, k, _ in spans])
        assert [(m.start, m.start - m.neg, m.rule) for m in got[i]] == [(a, b, r) for a, b, r, _ in want]


def test_entropy_matches_the_twin(spark):
    rng = random.Random(9)
    values = ["".join(rng.choice("abcdEFGH0123+/_-é") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", S.entropy(F.col("v")).alias("e")).collect():
        assert abs(r.e - twin.entropy(r.v)) < 1e-9


def test_scrub_replaces_longest_first(spark):
    df = spark.createDataFrame([("abcdefgh abcdef xyz abc",)], "t string")
    assert df.select(scrub(F.col("t"), ["abcdef", "abcdefgh", "abc"])).first()[0] == "******** ******** xyz abc"


def test_each_rule_is_evaluated_once_per_text(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = df.select(S.locate_spans(F.col("text"), S.detect_spans(F.col("text"))).alias("s"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all(lambda") <= 19 + 2 + 6
