"""Rules as rows against trying every rule on every text."""

import random
import re

import pytest

from hushscan.operators import rule_table as R
from hushscan.operators.detect import detect
from hushscan.operators.rules import compile_rules
from hushscan.options import Options


@pytest.mark.parametrize(
    "pattern, literal",
    [
        (r"\b(corp_[a-z]{32})\b", "corp_"), ("abc|abd", "ab"), ("a|b", None), ("(?:xy)?abc", "abc"), ("(?:xyz)+ab", "xyz"),
        ("(?i)abcdef", None), ("ab(?i:cdef)", "ab"), ("a*b+", "b"), ("[0-9]{4}", None), (r"x\.y\-z", "x.y-z"), ("", None),
        ("^key=$", "key="), ("(?=look)ab", "ab"), ("(?!no)ab", "ab"), ("é+ü", "é"), ("a{0,3}bc", "bc"), ("(a(b(cde)))f", "cde"),
    ],
)
def test_required_literal(pattern, literal):
    assert R.required_literal(pattern) == literal


def test_every_match_holds_the_literal():
    draw = random.Random(6)

    def some(depth):
        kind = draw.randrange(8 if depth else 3)
        if kind < 2:
            return draw.choice("abc")
        if kind == 2:
            return draw.choice(["[ab]", ".", r"\w", "[^c]"])
        inner = "".join(some(depth - 1) for _ in range(draw.randint(1, 3)))
        return {3: f"({inner})", 4: f"(?:{inner}|{some(depth - 1)})", 5: f"(?:{inner})?", 6: f"(?:{inner}){{1,2}}", 7: f"(?i:{inner})"}[kind]

    hit = 0
    for _ in range(3000):
        pattern = "".join(some(2) for _ in range(draw.randint(1, 3)))
        literal = R.required_literal(pattern)
        text = "".join(draw.choice("abcAB") for _ in range(12))
        for m in re.finditer(pattern, text):
            assert literal is None or literal in m.group(), (pattern, text)
            hit += 1
    assert hit > 1000


def test_rows_that_are_no_rules(spark):
    rows = [("b", "x+"), ("a", "("), (None, "x"), ("", "x"), ("c", None), ("c", ""), ("b", "x+"), ("d", "[" * 3)]
    got = R.read_rules(spark.createDataFrame([(*r, 1) for r in rows], "name string, pattern string, literal int").repartition(3)).collect()
    assert sorted(r.rule_index for r in got) == list(range(8))
    assert [(r.name, r.literal) for r in sorted(got) if r.message is None] == [("b", "x"), ("b", "x")]
    assert sorted((r.name or "", r.message) for r in got if r.message) == [
        ("", 'missing or invalid "name"')] * 2 + [("a", "invalid regular expression"), ("c", 'missing or invalid "pattern"'),
        ("c", 'missing or invalid "pattern"'), ("d", "invalid regular expression")]


def test_many_rules_equal_trying_all(spark):
    draw = random.Random(9)
    rules = [(f"r{i}", draw.choice([rf"k{i}=[a-z]+", rf"\bid{i}\b", rf"(?:x|y){i}z{{2}}", rf"T-{i:05d}-[0-9A-F]{{4}}"])) for i in range(5000)]
    rules += [("digits", "[0-9]{9}"), ("folded", "(?i)secretly"), ("empty", "q*")]
    bits = [lambda n: f"k{n}=abc", lambda n: f"id{n}", lambda n: f"x{n}zz", lambda n: f"T-{n:05d}-12AF", lambda n: "words between", lambda n: str(n) * 4, lambda n: "SeCretly", lambda n: "qqq"]
    texts = [(str(i), " ".join(draw.choice(bits)(draw.randrange(5200)) for _ in range(draw.randint(0, 12)))) for i in range(300)]
    texts += [("copy", texts[5][1]), ("null", None), ("emoji", "😀 id7 😀 k7=q")]
    df = spark.createDataFrame([(*t, 3) for t in texts], "source_id string, text string, rule int").repartition(3)
    table = spark.createDataFrame(rules, "name string, pattern string")
    options = Options(apply_placeholders=False)
    found = R.detect_with_rules(df, table, options=options, keep=("rule",))
    got = sorted((r.source_id, r.kind, r.start, r.end) for r in found.where("custom").collect())
    want = sorted((s, n, m.start(), m.end()) for n, p in rules for s, t in texts if t for m in re.finditer(p, t) if m.group())
    assert got == want and len(got) > 500
    plain = detect(df, options=options)
    assert found.where("NOT custom").count() == plain.count()


def test_table_and_options_find_the_same(spark):
    rules = [("A", "A[0-9]+"), ("N", "(?P<q>['\"])n+(?P=q)"), ("W", r"\d+é")]
    texts = [("s", "😀 A12 'nn' A7 1²3é A0  # hushscan:ignore\nA9 your_A1"), ("t", "none")]
    df = spark.createDataFrame(texts, "source_id string, text string")
    made = compile_rules(spark, [{"name": n, "pattern": p} for n, p in rules])
    one = detect(df, options=Options(rules=made.rules))
    two = R.detect_with_rules(df, spark.createDataFrame(rules, "name string, pattern string"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


def test_the_plan_does_not_grow_with_rules(spark):
    df = spark.createDataFrame([("a", "k1=x")], "source_id string, text string")

    def size(n):
        table = spark.range(n).selectExpr("concat('r', id) AS name", "concat('k', id, '=x') AS pattern")
        return len(R.detect_with_rules(df, table)._jdf.queryExecution().optimizedPlan().toString())

    few, many = size(2), size(5000)
    assert many < 1.1 * few


def test_no_rules_and_no_texts(spark):
    df = spark.createDataFrame([("a", "k1=x"), (None, None)], "source_id string, text string")
    none = spark.createDataFrame([], "name string, pattern string")
    assert R.detect_with_rules(df, none).count() == 0
    rule = spark.createDataFrame([("r", "k1")], "name string, pattern string")
    assert R.detect_with_rules(df.where("source_id = 'z'"), rule).count() == 0


def test_rules_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    from hushscan.operators.rule_table import read_rules

    rows = spark.range(300).selectExpr("concat('r', id) AS name", "concat('lit-', id, '-[0-9]+') AS pattern")
    rows.coalesce(1).write.parquet(f"{tmp_path}/rules")
    read = read_rules(spark.read.parquet(f"{tmp_path}/rules"))
    assert read.rdd.getNumPartitions() >= 4
    assert "MapInArrow" in (plan := read._jdf.queryExecution().optimizedPlan().toString()) and plan.index("MapInArrow") < plan.index("Repartition")
    assert [r.name for r in read.orderBy("rule_index").collect()] == sorted(f"r{i}" for i in range(300))


def test_a_text_is_shuffled_once_to_meet_its_rules(spark):
    """Texts were held and shuffled three times, and every gram of every literal with a key of 64 characters."""
    from test_triage import _shuffled

    texts = spark.createDataFrame([(f"s{i}", f"text {i % 50} with id{i % 50} in it") for i in range(100)], "source_id string, text string")
    rules = spark.range(60).selectExpr("concat('r', id) AS name", r"concat('\\bid', id, '\\b') AS pattern")
    out = R.with_rule_spans(texts, R.read_rules(rules))
    moved = [m.replace("`", "") for m in _shuffled(out)]
    assert sum("text STRING" in m for m in moved) == 1
    found = {r.source_id: [s.kind for s in r._custom] for r in out.collect()}
    assert found == {f"s{i}": [f"r{i % 50}"] for i in range(100)}
