"""Suppression, baseline, rules, fixes, lines and streams."""

import ast
import random

import samples
import twin
from pyspark.sql import functions as F

from hushscan.functions.markers import parse_markers
from hushscan.operators import baseline as B, fixes, lines, redact, rules, suppress
from hushscan.operators.detect import detect, finding_id, public, scan_texts
from hushscan.options import Options
from hushscan.sources.config import load_baseline, write_baseline
from hushscan.streaming import reassembly, redaction as stream

GH = "ghp_" + samples.BODY[:36]
GL = "glpat-" + samples.BODY[:20]


def frame(spark, texts):
    return spark.createDataFrame(texts, "source_id string, text string")


# --- markers --------------------------------------------------------------------


def test_marker_grammar(spark):
    everything, cases = None, [
        ("x # hushscan:ignore", [(1, None)]),
        ("/* hushscan:ignore */", [(1, None)]),
        ("# hushscan: \t ignore because", [(1, None)]),
        ("#hushscan:ignore[github_token]", [(1, ["github_token"])]),
        ("a\n# hushscan:ignore-next-line\nb", [(3, None)]),
        ("# hushscan:ignore[ a ,b,, My Rule ]", [(1, ["a", "b", "My Rule"])]),
        ("# hushscan:ignore[]", [(1, [])]),
        ("# hushscan:ignore[abc", [(1, None)]),
        ("# hushscan:ignored", []), ("# hushscan:ignore-nextline", []), ("# hushscan:ignore-next-line-please", []),
        ("# hushscan:ignore_all", []), ("# HUSHSCAN:IGNORE", []), ("# hushscan: x hushscan:IGNORE", []),
        ("# hushscan ignore", []), ("a\x0cb c\n# hushscan:ignore\r\n", [(2, None)]),
        ("hushscan:ignore hushscan:ignore-next-line[k]", [(1, None), (2, ["k"])]),
    ]
    df = frame(spark, [(str(i), t) for i, (t, _) in enumerate(cases)])
    for r in df.select("source_id", parse_markers(F.col("text"), "hushscan:").alias("m")).collect():
        got = [(m.line, None if m.all_kinds else m.kinds) for m in r.m]
        assert got == cases[int(r.source_id)][1], cases[int(r.source_id)][0]


TEXTS = [
    ("same", f"k='{GH}' # hushscan:ignore\nj='{GL}'"),
    ("next", f"# hushscan:ignore-next-line\nk='{GH}'\nj='{GL}'"),
    ("kind", f"k='{GH}' {GL} # hushscan:ignore[gitlab_token]"),
    ("wrong", f"k='{GH}' # hushscan:ignore[npm_token]"),
    ("both", f"# hushscan:ignore-next-line[npm_token]\nk='{GH}' # hushscan:ignore[github_token]"),
    ("wide", f"# hushscan:ignore-next-line\nk='{GH}' # hushscan:ignore[npm_token]"),
    ("rule", "INT-1 # hushscan:ignore[My Rule]"),
    ("holder", "token = changeme\npassword: your_api_key_here"),
]
KEPT = {("same", "gitlab_token", 2), ("next", "gitlab_token", 3), ("kind", "github_token", 1), ("wrong", "github_token", 1)}


def test_suppression_in_row_equals_the_join(spark):
    opts = Options(rules=(("My Rule", "(?dU)INT-[0-9]+"),))
    df = frame(spark, TEXTS)
    keys = lambda d: {(r.source_id, r.kind, r.line) for r in d.collect()}
    assert keys(detect(df, options=opts)) == KEPT
    unmarked = detect(df, options=opts.but(apply_markers=False))
    marks = suppress.markers(df, options=opts)
    assert keys(suppress.apply_markers(unmarked, marks)) == KEPT
    hidden = suppress.suppressed(unmarked, marks)
    assert hidden.count() == scan_texts(df, options=opts).agg(F.sum("inline_ignored")).first()[0] == 6
    row = {(r.source_id, r.line): r for r in marks.collect()}[("both", 2)]
    assert row.kinds == ["github_token", "npm_token"] and row.all_kinds is False


def test_placeholders_follow_the_twin(spark):
    values = ["changeme", "'CHANGEME'", "your-prod-password1", "yourname1", "xxxxXXXX", "xxxxxxxy", " todo ", "todos", "", '"x"']
    df = spark.createDataFrame([(v,) for v in values], "v string")
    from hushscan.functions.spans import is_placeholder

    for r in df.select("v", is_placeholder(F.col("v")).alias("p")).collect():
        assert r.p is twin.placeholder(r.v), r.v


# --- baseline -------------------------------------------------------------------


def test_baseline_round_trip_and_former_kinds(spark, tmp_path):
    df = frame(spark, [("a", GH), ("b", GL), ("c", "npm_" + samples.BODY[:36])])
    found = detect(df)
    path = str(tmp_path / "base")
    write_baseline(found.where("source_id = 'a'"), path)
    saved = spark.read.text(path).collect()
    assert all(GH not in r.value for r in saved)
    base = load_baseline(spark, path)
    old = spark.createDataFrame([("b", "high_entropy", GL), ("c", "github_token", "npm_" + samples.BODY[:36])], "f string, k string, v string")
    old = old.select(finding_id(F.col("f"), F.col("k"), F.col("v")).alias("id"), F.col("f").alias("file"), F.col("k").alias("kind"), F.lit(1).alias("line"))
    both = base.unionByName(old)
    assert {r.source_id for r in B.new_findings(found, both).collect()} == {"c"}
    assert {r.source_id for r in B.accepted_findings(found, both).collect()} == {"a", "b"}
    assert {r.source_id for r in B.new_findings(found, both, legacy=False).collect()} == {"b", "c"}
    assert {r.file for r in B.resolved(both, found).collect()} == {"c"}


def test_baseline_documents(spark, tmp_path):
    assert load_baseline(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "doc.json").write_text('{"generated_at": "x",\n "findings": [\n{"id": "1", "file": "f", "kind": "k", "line": 3}, {"file": "g"}]}\n')
    assert [tuple(r) for r in load_baseline(spark, str(tmp_path / "doc.json")).collect()] == [("1", "f", "k", 3)]
    for bad in ("not json", "[1, 2]", "{}", ""):
        (tmp_path / "bad.json").write_text(bad)
        assert load_baseline(spark, str(tmp_path / "bad.json")).count() == 0


# --- rules ----------------------------------------------------------------------


def test_custom_rules(spark):
    given = [{"name": "A", "pattern": "A[0-9]+"}, {"name": "G", "pattern": "ghp_[A-Za-z0-9]+"}, {"name": "Z", "pattern": "x*"},
             {"name": "N", "pattern": "(?P<q>['\"])n+(?P=q)"}, {"name": "bad", "pattern": "("}, 7]
    made = rules.compile_rules(spark, given)
    assert [n for n, _ in made.rules] == ["A", "G", "Z", "N"] and [e[0] for e in made.errors] == [4, 5]
    opts = Options(rules=made.rules)
    text = f"😀 A12 xx yx {GH} 'nn' A7"
    got = sorted((r.kind, r.start, r.end, r.custom) for r in detect(frame(spark, [("s", text)]), options=opts).collect())
    at = text.index
    assert got == sorted([
        ("A", at("A12"), at("A12") + 3, True), ("A", at("A7"), at("A7") + 2, True),
        ("G", at(GH), at(GH) + 40, True), ("github_token", at(GH), at(GH) + 40, False), ("N", at("'nn'"), at("'nn'") + 4, True),
    ])  # the x* matches are placeholders
    unfiltered = opts.but(apply_placeholders=False)
    text = text[1:]  # empty matches are only exact outside surrogate pairs
    z = [(r.start, r.end) for r in detect(frame(spark, [("s", text)]), options=unfiltered).where("kind = 'Z'").collect()]
    assert z == [(at("xx") - 1, at("xx") + 1), (at("yx"), at("yx") + 1)]
    tried = rules.test_rules(spark.createDataFrame([("1", "😀" + text), ("2", "none")], "sample_id string, text string"), made.rules)
    rows = {(r.rule, r.sample_id): (r.matched, r.start, r.end) for r in tried.collect()}
    assert rows[("A", "1")] == (True, 2, 5) and rows[("A", "2")] == (False, None, None)
    table = spark.createDataFrame([("b", "b+"), ("a", "a+")], "name string, pattern string")
    assert [n for n, _ in rules.rules_from_table(table).rules] == ["a", "b"]


# --- nested redaction -------------------------------------------------------------


def test_nested_values_are_redacted_one_by_one(spark):
    schema = "msg string, args array<string>, named map<string,string>, s struct<a:string,n:int,l:array<struct<b:string>>>, n int"
    df = spark.createDataFrame([(
        "password=%s", ["MyDogFluffy99", f"token={GH}"], {"k": "secret: hunter2hunter2", GH: "v"},
        (GH, 3, [("x",), (GL,)]), 5,
    ), (None, None, None, None, None)], schema)
    out = redact.redact_nested(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    first, second = out.collect()
    assert first.msg == "password=%s" and first.args == ["MyDogFluffy99", "token=********"]
    assert first.named == {"k": "secret: ********", GH: "v"}
    assert (first.s.a, first.s.n, [x.b for x in first.s.l], first.n) == ("********", 3, ["x", "********"], 5)
    assert tuple(second) == (None,) * 5
    assert redact.redact_nested(df, options=Options(enabled=False)).first().s.a == GH


# --- fixes ------------------------------------------------------------------------


def python_oracle(line, value):
    try:
        tree = ast.parse(line.strip())
    except SyntaxError:
        return False
    return (
        len(tree.body) == 1 and isinstance(tree.body[0], ast.Assign) and len(tree.body[0].targets) == 1
        and isinstance(tree.body[0].targets[0], ast.Name) and isinstance(tree.body[0].value, ast.Constant)
        and tree.body[0].value.value == value
    )


def test_assignments(spark):
    v = samples.BODY[:30]
    py = [
        (f'API_KEY = "{v}"', 'API_KEY = os.getenv("K")'), (f"    key='{v}'  # note", "    key = os.getenv('K')"),
        (f'x = "{v}";', 'x = os.getenv("K")'), (f'h = {{"a": "{v}"}}', None), (f'f("{v}")', None), (f'x = f"{v}"', None),
        (f'x = "a" + "{v}"', None), (f'x = y = "{v}"', None), (f'None = "{v}"', None), (f'x = "{v}" "b"', None),
        (f'# x = "{v}"', None), ("", None), (f'x: str = "{v}"', None), (f'x.y = "{v}"', None), (f'x = """{v}"""', None),
    ]
    js = [
        (f'const API_KEY = "{v}";', 'const API_KEY = process.env["K"]%;'), (f"let a = '{v}'", 'let a = process.env["K"]%'),
        (f'export const a: string = "{v}"; // c', 'export const a: string = process.env["K"]%;'),
        (f"  var a = `{v}`;", '  var a = process.env["K"]%;'), (f"const t = `Bearer ${{{v}}}`;", None),
        (f'const a = "{v}", b = "x";', None), ('const a = "other";', None), (f'const h = {{a: "{v}"}};', None), (f'a = "{v}"', None),
    ]
    rows = [("a.py", line, want) for line, want in py]
    rows += [("a.js", line, want and want.replace("%", "")) for line, want in js]
    rows += [("a.tsx", line, want and want.replace("%", "!")) for line, want in js] + [("a.rb", py[0][0], None)]
    df = spark.createDataFrame(rows, "p string, l string, want string")
    a = fixes.assignment(F.col("l"), F.col("p"), F.lit(v))
    for r in df.select("*", F.concat(a["head"], F.lit("K"), a["tail"]).alias("got")).collect():
        assert r.got == r.want, r
        if r.p == "a.py" and r.got:
            assert python_oracle(r.l, v)


def test_env_names(spark):
    pairs = [("apiKey", "API_KEY"), ("myAPIKey", "MY_API_KEY"), ("api_key", "API_KEY"), ("OPENAI_API_KEY", "OPENAI_API_KEY"),
             ("$x$y", "X_Y"), ("__", "SECRET_KEY"), ("a1B", "A1_B")]
    df = spark.createDataFrame(pairs, "n string, want string")
    for r in df.select("want", fixes.suggest_env_name(F.col("n")).alias("got")).collect():
        assert r.got == r.want


def claim_in_order(rows, existing):
    taken, out = {}, {}
    for project, key in existing:
        taken.setdefault(project, set()).add(key)
    for project, file, start, desired in sorted(rows):
        used, key, n = taken.setdefault(project, set()), desired, 2
        while key in used:
            key, n = f"{desired}_{n}", n + 1
        used.add(key)
        out[(project, file, start)] = key
    return out


def test_env_keys_equal_claiming_in_order(spark):
    rng = random.Random(3)
    for names in (["A", "B", "C_KEY"], ["A", "A_2", "A_2_2", "A_3", "B", "B_1"]):
        rows = list({("p%d" % rng.randint(0, 2), "f%d" % rng.randint(0, 5), rng.randint(0, 99)): None for _ in range(120)})
        rows = [(p, f, s, rng.choice(names)) for p, f, s in rows]
        existing = [("p%d" % rng.randint(0, 2), rng.choice(names) + rng.choice(["", "_2", "_4", "_02", "_1", "_X"])) for _ in range(8)]
        df = spark.createDataFrame(rows, "project string, file string, start int, desired string").repartition(3)
        ex = spark.createDataFrame(existing, "project string, key string")
        got = {(r.project, r.file, r.start): r.env_key for r in fixes.assign_env_keys(df, ex).collect()}
        assert got == claim_in_order(rows, existing)


def test_fix_plan(spark):
    texts = [("p", "a.py", f"import os\napiKey = '{GH}'\napiKey = '{GL}'\nf('{GH}')\n"), ("p", "b.rb", f"k = '{GH}'")]
    df = spark.createDataFrame(texts, "project string, path string, text string")
    env = fixes.env_keys(spark.createDataFrame([("p", "API_KEY = 1"), ("p", "# X=1"), ("p", "")], "project string, line string"))
    got = {(r.file, r.line): (r.fixable, r.env_key, r.proposed_line, r.language) for r in fixes.fix_plan(df, env).collect()}
    assert got == {
        ("a.py", 2): (True, "API_KEY_2", "apiKey = os.getenv('API_KEY_2')", "py"),
        ("a.py", 3): (True, "API_KEY_3", "apiKey = os.getenv('API_KEY_3')", "py"),
        ("a.py", 4): (False, None, None, "py"),
        ("b.rb", 1): (False, None, None, "rb"),
    }


# --- lines and streams --------------------------------------------------------------


def released(chunks, cap):
    out, buffers = {}, {}
    for sid, _, text, flush in sorted(chunks):
        got = out.setdefault(sid, [])
        buf = buffers.get(sid, "") + text
        *done, buf = buf.split("\n")
        got += [d + "\n" for d in done]
        if buf and (flush or len(buf) > cap):
            got.append(buf)
            buf = ""
        buffers[sid] = buf
    for sid, buf in buffers.items():
        if buf:
            out[sid].append(buf)
    return out


def make_chunks(seed, n=300):
    rng = random.Random(seed)
    pieces = ["a", "password: ", "hunter2hunter2", "\n", "", "x" * 9, "b\nc", "\n\n", "é😀"]
    return [("s%d" % rng.randint(0, 2), i, "".join(rng.choices(pieces, k=rng.randint(0, 3))), rng.random() < 0.1) for i in range(n)]


CHUNK = "stream_id string, seq long, fragment string, flush boolean"


def test_batch_reassembly(spark):
    for cap in (12, 65_536):
        chunks = make_chunks(cap)
        df = spark.createDataFrame(chunks, CHUNK).repartition(3)
        out = lines.reassemble(df, flush="flush", cap=cap, block=17).orderBy("stream_id", "part", "ord").collect()
        got = {}
        for r in out:
            got.setdefault(r.stream_id, []).append(r.line)
        assert got == {k: v for k, v in released(chunks, cap).items() if v}


def run(query_frame, tmp_path, name, mode="append"):
    spark = query_frame.sparkSession
    q = (query_frame.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(1)
    values = [GH, GL, "plain", "npm_" + samples.BODY[:36]]
    rows = [(str(i % 7), f"k = '{rng.choice(values)}'", i) for i in range(60)]
    df = spark.createDataFrame(rows, "source_id string, text string, i int")
    df = df.withColumn("ts", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("i"))))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    live = lambda: spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    assert same(run(stream.redact_stream(live()), tmp_path, "redacted"), stream.redact_stream(source))
    found = run(stream.findings_stream(live(), keep=("ts",)), tmp_path, "found")
    assert "value" not in found.columns
    assert same(found, public(detect(source, keep=("ts",))))
    first = run(stream.first_seen_stream(stream.findings_stream(live(), keep=("ts",)), delay="1 day"), tmp_path, "first")
    ids = {r.finding_id for r in first.collect()}
    assert len(ids) == first.count() and ids == {r.finding_id for r in found.collect()}
    counts = run(stream.alert_counts(stream.findings_stream(live(), keep=("ts",)), delay="1 second"), tmp_path, "counts", "complete")
    assert same(counts, stream.alert_counts(found))
    told = run(stream.alerts(live()), tmp_path, "told")
    assert told.count() == source.where("text not like '%plain%'").count() and "text" not in told.columns
    assert stream.alerts(source, options=Options(notify=False)).count() == 0


def test_stream_reassembly(spark, tmp_path):
    chunks = make_chunks(4, 120)
    df = spark.createDataFrame(chunks, CHUNK).repartitionByRange(3, "seq").sortWithinPartitions("seq")
    df.write.parquet(str(tmp_path / "in"))
    import os
    parts = sorted(f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet"))
    for i, f in enumerate(parts):  # read in order of modification
        os.utime(tmp_path / "in" / f, (1_700_000_000 + i, 1_700_000_000 + i))
    live = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run(reassembly.reassemble_lines(live, flush="flush", cap=12), tmp_path, "lines")
    got = {}
    for r in out.orderBy("stream_id", "ord").collect():
        got.setdefault(r.stream_id, []).append(r.line)
    want = released(chunks, 12)
    waiting = {k: (v[:-1] if not v[-1].endswith("\n") and len(v[-1]) <= 12 and got.get(k) != v else v) for k, v in want.items()}
    assert got == waiting


def test_invalid_text_is_withheld(spark):
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xffk"),)], "b binary").select(F.col("b").cast("string").alias("text"))
    got = sorted((r.quarantined, r.text) for r in stream.quarantine(df).collect())
    assert got == [(False, "ok"), (True, None)]


def test_a_line_is_rewritten_once(spark):
    opts = Options(rules=(("Own", "ghp_[A-Za-z0-9]+"), ("Own 2", "ghp_[A-Za-z0-9]+")))
    texts = [("p", "a.py", f"api_key = '{GH}'\n"), ("p", "b.py", f"api_key_2 = '{GH}'\n")]
    df = spark.createDataFrame(texts, "project string, path string, text string")
    rows = fixes.fix_plan(df, options=opts).collect()
    assert len(rows) == 6
    fixed = {r.file: (r.env_key, r.proposed_line) for r in rows if r.fixable}
    assert sum(r.fixable for r in rows) == 2
    assert fixed["a.py"][0] == "API_KEY" and fixed["b.py"][0] == "API_KEY_2"


def test_claims_skip_many_existing_numbers(spark):
    rows = [("p", f"f{i:03}", i, "K") for i in range(60)]
    taken = [("p", f"K_{n}") for n in (2, 3, 5, 8, 13, 21, 34, 55, 61, 62, 63, 900)] + [("p", "K"), ("q", "K_4"), ("p", "K_04")]
    df = spark.createDataFrame(rows, "project string, file string, start int, desired string")
    ex = spark.createDataFrame(taken, "project string, key string")
    got = [r.env_key for r in fixes.assign_env_keys(df, ex).orderBy("file").collect()]
    used, want, n = {k for p, k in taken if p == "p"}, [], 1
    while len(want) < 60:
        name = "K" if n == 1 else f"K_{n}"
        if name not in used:
            want.append(name)
        n += 1
    assert got == want


def test_rule_patterns_are_read_by_token():
    assert rules.to_java(r"\(?P<a>") == r"(?dU)\(?P<a>"
    assert rules.to_java(r"[(?P<]") == "(?dU)[(?P<]"
    assert rules.to_java(r"(?P<n>[]x&&])(?P=n)") == r"(?dU)(?<n>[\]x\&\&])\k<n>"


def test_malformed_baseline_rows_are_known(spark, tmp_path):
    from hushscan.sources.config import malformed_baseline_rows

    (tmp_path / "b.json").write_text('{"id":"1","file":"f","kind":"k","line":3}\n{"id":"2"\nnonsense\n')
    path = str(tmp_path / "b.json")
    assert [r.id for r in load_baseline(spark, path).collect()] == ["1"]
    assert sorted(r.malformed for r in malformed_baseline_rows(spark, path).collect()) == ["nonsense", '{"id":"2"']
    assert malformed_baseline_rows(spark, str(tmp_path / "none")).collect() == []
