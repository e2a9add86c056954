import hashlib
import random

import samples
from pyspark.sql import functions as F

from hushscan.operators import reports, triage
from hushscan.operators.detect import detect
from hushscan.operators.search import line_hits, lines_of
from hushscan.options import Options

TOKENS = dict(samples.POSITIVE)


def test_providers(spark):
    b = samples.BODY
    cases = [
        ("aws_access_key_id", TOKENS["aws_access_key_id"], "AWS", "IAM access key", True),
        ("aws_secret_access_key", TOKENS["aws_secret_access_key"], "AWS", "secret access key (part of an IAM access key pair)", True),
        ("github_token", "ghp_" + b[:36], "GitHub", "personal access token (classic)", True),
        ("github_token", "github_pat_" + b[:36], "GitHub", "fine-grained personal access token", True),
        ("github_token", "ghs_" + b[:36], "GitHub", "GitHub App installation access token", True),
        ("stripe_key", "pk_" + "live_" + b[:24], "Stripe", "publishable key", False),
        ("stripe_key", "rk_" + "test_" + b[:24], "Stripe", "restricted API key (test mode)", True),
        ("stripe_key", "sk_" + "live_" + b[:24], "Stripe", "secret API key", True),
        ("anthropic_api_key", "sk-" + "ant-admin01-" + b, "Anthropic", "Admin API key", True),
        ("gitlab_token", "gldt-" + b[:20], "GitLab", "deploy token", True),
        ("jwt", TOKENS["jwt"], None, "JWT", True),
        ("private_key_block", TOKENS["private_key_block"], None, "private key", True),
        ("My Rule", "INT-1", None, "credential", True),
        ("github_token", "totally-not-a-token", None, "credential", True),
        ("stripe_key", b, None, "credential", True),
    ]
    df = spark.createDataFrame(cases, "kind string, value string, p string, c string, rot boolean")
    for r in triage.identify(df).collect():
        assert r.provider == (r.p or "Unknown provider"), r
        assert r.credential == r.c and r.needs_rotation is r.rot and r.identified is (r.p is not None)
        assert bool(r.steps) is r.rot


def test_core_values_and_needles(spark):
    key = TOKENS["private_key_block"]
    cases = [
        ("aws_secret_access_key", TOKENS["aws_secret_access_key"], samples.BODY[:40], samples.BODY[:40]),
        ("bearer_token", "BEARER \t abcdefghijk", "abcdefghijk", "abcdefghijk"),
        ("private_key_block", key, key, samples.BODY),
        ("x", "plain", "plain", "plain"),
        ("x", "-----\n-----", "-----\n-----", "-----\n-----"),
    ]
    df = spark.createDataFrame(cases, "kind string, value string, core string, needle string")
    core = triage.core_value(F.col("kind"), F.col("value"))
    for r in df.select("core", "needle", core.alias("c"), triage.history_needle(core).alias("n")).collect():
        assert (r.c, r.n) == (r.core, r.needle)


def test_line_hits_equal_brute_force(spark):
    rng = random.Random(2)
    alphabet = "abAB01-_ é😀"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    needles = {word(rng.choice([1, 2, 3, 5, 7, 9, 14, 20])) for _ in range(60)} | {"abAB01abAB01ab", "0" * 13}
    needles |= {"a1B2c3D4e5F6" + w for w in ("", "-x", "zz")} | {"-a1B2c3D4e5F6g7-"}
    pool = sorted(needles)
    texts = []
    for i in range(120):
        lines = ["".join(rng.choice([word(rng.randint(0, 12)), rng.choice(pool)]) for _ in range(3)) for _ in range(4)]
        texts.append((str(i), "\n".join(lines)))
    df = spark.createDataFrame(texts, "file string, text string")
    nd = spark.createDataFrame([(n, n) for n in pool], "needle_id string, needle string")
    got = {tuple(r) for r in line_hits(lines_of(df, ["file"]), nd, ["file", "line_no"]).collect()}
    want = {
        (n, f, i)
        for f, text in texts
        for i, line in enumerate(text.split("\n"), 1)
        for n in pool
        if n in line
    }
    assert got == want and len(want) > 500


def find_all(text, core):
    at, out = text.find(core), set()
    while at >= 0:
        out.add(text.count("\n", 0, at) + 1)
        at = text.find(core, at + len(core))
    return out


def test_credentials_references_and_worklist(spark):
    key = TOKENS["private_key_block"]
    gh, aws, pk = TOKENS["github_token"], TOKENS["aws_secret_access_key"], "pk_" + "live_" + samples.BODY[:24]
    texts = [(f"f{i:02}.py", f"x = 1\nt = '{gh}'\n") for i in range(7)]
    texts += [
        ("a.py", f"{aws}\n# {samples.BODY[:40]}\n"),
        ("k.pem", f"\n{key}\nmiddle\n{key}\n"),
        ("k2.pem", "one\n" + samples.BODY + "\n"),
        ("l.py", f"password = '{gh}'\nBearer {gh[4:]}\n{pk}"),
    ]
    df = spark.createDataFrame(texts, "source_id string, text string").repartition(3)
    found = detect(df)
    creds = triage.credentials(found)
    rows = {r.core: r for r in creds.collect()}
    assert rows[gh].kind == "github_token" and rows[gh].n_locations == 8 and rows[gh].more_locations == 3
    assert [tuple(x) for x in rows[gh].locations] == [(f"f{i:02}.py", 2) for i in range(5)]
    assert tuple(rows[gh].first_location) == ("f00.py", 2)
    refs = triage.references(creds, df)
    got = {tuple(r) for r in refs.collect()}
    want = {
        (rows[c].credential_id, f, line) for c in rows for f, text in texts for line in find_all(text, c)
    }
    assert got == want
    status = spark.createDataFrame([(rows[gh].credential_id, True)], "credential_id string, revoked boolean")
    work = triage.worklist(creds, refs, status)
    state = {r.core: r for r in work.collect()}
    assert state[gh].resolved is False and state[gh].refs_remaining == 8
    assert state[pk].resolved is True
    assert triage.rollup(work).first()["unresolved"] == len(rows) - 1
    gone = triage.worklist(creds, refs.where(F.col("credential_id") != rows[gh].credential_id), status)
    assert {r.core: r.resolved for r in gone.collect()}[gh] is True


def test_history_references(spark):
    gh = TOKENS["github_token"]
    lines = [
        ("r", 0, "c2", 0, "@@commit c2"), ("r", 1, "c2", 0, f"-k = {gh}"), ("r", 2, "c2", 0, f" k = {gh}"),
        ("r", 3, "c1", 1, f"+k = {gh}"), ("r", 4, None, None, gh), ("r", 5, "c0", 2, "+nothing"),
    ]
    patch = spark.createDataFrame(lines, "repo string, line_no long, commit string, rank long, line string")
    df = spark.createDataFrame([("a", gh)], "source_id string, text string")
    got = triage.history_references(triage.credentials(detect(df)), patch).first()
    assert got.history_commits == 2 and got.commits == ["c2", "c1"]


def test_reports(spark, tmp_path):
    import json

    opts = Options(rules=(("My Rule!", "(?dU)INT-[0-9]+"), ("my rule", "(?dU)INX-[0-9]+")))
    texts = [("./a b.py", f"x\n😀k = '{TOKENS['github_token']}' INT-12\n"), ("c.py", "INX-7\n"), ("d.py", "ok")]
    df = spark.createDataFrame(texts, "source_id string, text string")
    found = detect(df, options=opts)
    rows = reports.sarif_rows(found, opts)
    assert "value" not in rows.columns and "finding_id" not in rows.columns
    log = json.loads(reports.sarif_logs(rows, opts, units_scanned=3).first().value)
    run = log["runs"][0]
    results = run["results"]
    assert [r["ruleId"] for r in results] == ["hushscan.github_token", "hushscan.custom.my-rule", "hushscan.custom.my-rule-2"]
    ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert all(ids[r["ruleIndex"]] == r["ruleId"] for r in results)
    place = results[0]["locations"][0]["physicalLocation"]
    assert place["artifactLocation"]["uri"] == "a%20b.py"
    assert place["region"] == {"startLine": 2, "startColumn": 8, "endLine": 2, "endColumn": 8 + len(TOKENS["github_token"])}
    assert results[1]["message"]["text"].startswith('Match of the rule "My Rule!".')
    assert run["invocations"][0]["properties"] == {"filesScanned": 3}
    pages = reports.sarif_logs(rows, opts, per_log=1).collect()
    assert sum(p.results for p in pages) == 3 and len(pages) == 3
    empty = json.loads(reports.sarif_logs(rows.limit(0), opts).first().value)
    assert empty["runs"][0]["results"] == []
    assert reports.gate(found) == 1 and reports.gate(found.limit(0)) == 0
    sev = {(r.category, r.level): r.findings for r in reports.by_severity(found, opts).collect()}
    assert sev[(None, None)] == 3 and sev[("possible secret", "error")] == 2
    from hushscan.operators.detect import scan_texts

    summary = reports.scan_summary(scan_texts(df, options=opts), found.where("kind = 'github_token'"))
    assert tuple(summary.first()) == (3, 1, 0, 2)
    assert json.loads(reports.json_summary(summary).first().value) == {
        "files_scanned": 3, "secrets_found": 1, "ignored_by_baseline": 2,
    }
    reports.write_json_report(found, summary, str(tmp_path / "r"))
    lines = spark.read.text(str(tmp_path / "r/matches")).collect()
    assert sorted(json.loads(r.value)["line"] for r in lines) == [1, 2, 2]
    assert all(TOKENS["github_token"] not in r.value for r in lines)


def test_literals_of_all_lengths_are_found_and_scrubbed(spark):
    from hushscan.operators import redact, search

    lines = [(i, t) for i, t in enumerate(["ab hunter2! x", "abcdefghijkl0123", "", None, "x" * 50, "hunter2!hunter2!", "ü-ü", "ü"])]
    df = spark.createDataFrame([*lines, (None, "no number: hunter2!")], "n int, line string")
    words = ["hunter2!", "abcdefghijkl", "xxxx", "ü", "ü-ü", "b", "nowhere at all"]
    # one literal under two ids, and an id of two literals
    pairs = [(w, w) for w in words] + [("again", "hunter2!"), ("again", "xxxx"), ("empty", ""), ("null", None)]
    needles = spark.createDataFrame(pairs, "needle_id string, needle string")
    want = {(i, n) for n, t in [*lines, (None, "no number: hunter2!")] for i, w in pairs if t and w and w in t}
    got = [(r.needle_id, r.n) for r in search.line_hits(df, needles, ["n"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    values = spark.createDataFrame([("hunter2!",), ("hunter2!hunter2!",), (None,), ("abc",), ("first line of it\n  second line of it \n",)], "value string")
    texts = spark.createDataFrame([(1, "a hunter2!hunter2! hunter2! abc", "k"), (2, "the second line of it.", "k"), (3, None, "k"), (1, "nothing", "k"), (1, "a hunter2!hunter2! hunter2! abc", "m")], "id int, text string, needle string")
    scrubbed = [(1, "a ******** ******** abc", "k"), (1, "a ******** ******** abc", "m"), (1, "nothing", "k"), (2, "the ********.", "k"), (3, None, "k")]
    out = redact.scrub_texts(texts, redact.scrub_literals(values))
    assert sorted(map(tuple, out.collect())) == scrubbed and out.columns == texts.columns
    nothing = spark.createDataFrame([], "needle_id string, needle string")
    assert search.line_hits(df, nothing, ["n"]).count() == 0 and redact.scrub_texts(texts, nothing).count() == 5


def test_winnowed_grams_of_a_literal_are_grams_of_its_lines(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from hushscan.operators import search

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abc0é😀-") for _ in range(n))
    prose = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40_000))
    _, grams = search.winnowed(*search._bytes_of(pa.array([prose])), 0)
    assert len(grams) < 0.1 * 40_000
    lines = [word(rng.randint(0, 300)) for _ in range(60)] + [""] * 3
    for chunk in (search._CHUNK, 50):
        monkeypatch.setattr(search, "_CHUNK", chunk)
        for tier, span in enumerate(search._SPANS):
            owner, grams = search.winnowed(*search._bytes_of(pa.array([None, *lines])), tier)
            have = {i: set(grams[owner == i].tolist()) for i in range(len(lines) + 1)}
            for i, line in enumerate(lines, 1):
                data = line.encode()
                plain = {_least(data[p : p + span], tier) for p in range(len(data) - span + 1)}
                assert have[i] == plain


def _least(window, tier):
    import numpy as np

    from hushscan.operators import search

    size = search.TIERS[tier][0]
    packed = [int.from_bytes(window[i : i + size], "little") for i in range(len(window) - size + 1)]
    return int(search._mixed(np.array(packed, np.uint64)).min().view(np.int64))


def test_only_filtered_grams_leave_the_scan(spark):
    from hushscan.operators import search

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(n))
    needles = spark.createDataFrame([(str(i), word(30)) for i in range(3000)], "key string, needle string")
    lines = spark.createDataFrame([(i, word(400)) for i in range(2000)], "n int, line string")
    grams = search.needle_grams(needles, "key").cache()
    bitmap, tiers = search.gram_filter(grams)
    assert tiers == [0] and 8 * len(bitmap) >= 16 * grams.count()
    left = search.with_grams(lines, "line", bitmap, tiers).select(F.sum(F.size("_grams")).alias("n")).first().n or 0
    assert left < 0.01 * 2000 * 400
    own = search.with_grams(needles, "needle", bitmap, tiers)
    assert own.where("_grams IS NULL").count() == 0  # what was put in is always found
    grams.unpersist()


def test_shared_tables_need_a_named_folder_on_a_cluster():
    import pytest
    from hushscan.operators.cluster import shared_folder

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_no_credential_reaches_the_shared_folder(spark):
    import os

    from hushscan.operators import cluster

    folder = cluster.shared_folder(spark).removeprefix("file:")
    cluster.release()
    before = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}
    token = TOKENS["github_token"]
    df = spark.createDataFrame([("a", f"k = '{token}'\n"), ("b", f"x\n{token}\n")], "source_id string, text string")
    creds = triage.credentials(detect(df))
    refs = triage.references(creds, df)
    assert {(r.file, r.line) for r in refs.collect()} == {("a", 1), ("b", 2)}
    written = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names} - before
    assert written and not any(token.encode() in open(f, "rb").read() for f in written)
    cluster.release(spark)
    after = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}
    assert not (after - before) and not cluster._TABLES and not cluster._HELD


def test_substring_joins_broadcast_no_side_that_a_step_made_larger(spark, tmp_path):
    """The optimizer takes exploded rows for as small as the files and had the driver collect them."""
    from hushscan.operators import redact, search

    lines = spark.createDataFrame([(i, f"some words of line {i} and token tok-{i:08d} in it") for i in range(50)], "n int, line string")
    needles = spark.createDataFrame([(f"k{i}", f"tok-{i:08d}") for i in range(0, 50, 2)], "needle_id string, needle string")
    for name, rows in (("lines", lines), ("needles", needles)):
        rows.write.parquet(f"{tmp_path}/{name}")  # files have a size the optimizer goes by
    lines, needles = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("lines", "needles"))
    hits = search.line_hits(lines, needles, ["n"])
    scrubbed = redact.scrub_texts(lines, needles, "line")
    for made in (hits, scrubbed):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {(r.needle_id, r.n) for r in hits.collect()} == {(f"k{i}", i) for i in range(0, 50, 2)}
    assert scrubbed.where(F.contains("line", F.lit("tok-"))).count() == 25


def test_literals_are_keyed_by_sixteen_bytes_and_their_grams_not_shuffled(spark):
    from hushscan.operators import search

    words = spark.createDataFrame([("k" * 40,), ("some literal of more than 27 bytes",)], "needle string").withColumn("key", search.digest("needle"))
    assert {len(r.key) for r in words.collect()} == {16}
    grams = search.needle_grams(words, "key")
    assert "Aggregate" not in grams._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in grams.select(F.hex("key"), "tier", "gram").collect()]
    assert len(rows) == len(set(rows)) and len({r[0] for r in rows}) == 2


def test_grams_the_filter_drops_take_no_memory(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from hushscan.operators import search

    monkeypatch.setattr(search, "_CHUNK", 1 << 16)
    said, places = search._bytes_of(pa.array(["".join(random.Random(3).choices("abcdefgh ", k=2_000_000))]))
    bitmap = np.random.default_rng(1).integers(0, 256, 1 << 12, dtype=np.uint8) & 17
    owner, grams = search.winnowed(said, places, 3)
    ok = search.passes(bitmap, grams)
    tracemalloc.start()
    mine = search.winnowed(said, places, 3, bitmap)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(mine[0], owner[ok]) and np.array_equal(mine[1], grams[ok])
    assert peak < 16 * len(grams)  # what all grams and their owners take


def _shuffled(frame) -> list[str]:
    """What each exchange of a plan moves, as schemas."""
    spark, found = frame.sparkSession, []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        todo = [frame.select("*")._jdf.queryExecution().executedPlan()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            found.append(node.schema().toDDL())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_lines_and_literals_are_shuffled_as_digests_and_only_hits(spark):
    """Literals, their grams and the lines were held and shuffled: more than ten times the texts."""
    from hushscan.operators import search

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopé ") for _ in range(n))
    texts = [(i, word(400)) for i in range(200)]
    lines = spark.createDataFrame(texts, "n int, line string")
    pieces = [t[i : i + 40] for _, t in texts for i in range(0, 400, 40)]
    needles = spark.createDataFrame([(p,) for p in [*pieces, "nowhere", ""]], "needle string")
    hits = search.line_hits(lines, needles, ["n"])
    moved = _shuffled(hits)
    assert len(moved) == 2 and not any("STRING" in m.upper() for m in moved)
    want = {(hashlib.md5(p.encode()).hexdigest(), n) for p in pieces for n, t in texts if p in t}
    got = [tuple(r) for r in hits.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_windows_hold_all_literals_and_little_else(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from hushscan.operators import search

    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abc0é😀-") for _ in range(n))
    rows = [word(rng.randint(0, 300)).encode() for _ in range(60)] + [b""] * 3 + [("é" * 900).encode()]
    literals = {t[a : a + n] for t in rows for n in (1, 2, 3, 5, 17, 31, 32, 40, 63, 64, 90, 200) for a in (0, 7, 33) if len(t) >= a + n}
    said, places = search._bytes_of(pa.array(rows, pa.binary()))
    for step in (search._STEP, 250):
        monkeypatch.setattr(search, "_STEP", step)
        for rounds in (1, 3):
            sizes = search.Sizes(tuple(sorted({len(x) for x in literals})), 18, rounds)
            made = [[np.zeros(1 << b >> 3, np.uint8) for b in (17, 18)] for _ in range(rounds)]
            for x in literals:
                data, width = np.frombuffer(x, np.uint8), search._width(len(x))
                front = search._known_by(data, np.array([0]), width)
                whole = search._whole(front, search._known_by(data, np.array([len(x) - width]), width), len(x))
                pair = made[int(search._round_of(front, rounds)[0])]
                for bitmap, bits, probes, hashes in zip(pair, (17, 18), search._PROBES, (front, whole)):
                    for nth in range(probes):
                        bit = int(search._bit(search._entries(hashes, bits), nth)[0])
                        bitmap[bit >> 3] |= 1 << (bit & 7)
            found = set()
            for nth in range(rounds):
                for owner, start, length in search.windows(said, places, sizes, made[nth], nth):
                    found |= {(o, bytes(said[s : s + n])) for o, s, n in zip(owner.tolist(), start.tolist(), length.tolist())}
            want = {(i, x) for i, t in enumerate(rows) for x in literals if x in t}
            assert want <= found and len(found) < 1.05 * len(want)


def test_literals_are_looked_up_in_rounds(spark, monkeypatch):
    """More literals than the filters tell apart: every round finds its share, and the rounds all of them."""
    from hushscan.operators import search

    monkeypatch.setattr(search, "_WHOLE_BITS", 18)
    rng = random.Random(13)
    texts = [(i, " ".join(f"{rng.randrange(36**6):x}" for _ in range(60))) for i in range(1000)]
    pairs = [(k, " ".join(t.split(" ")[i : i + 2])) for k, (_, t) in enumerate(texts) for i in range(0, 60, 1)]
    sizes = search.Sizes.of({10: len(pairs)})
    assert sizes.rounds == 3 and sizes.bits == 18
    lines = spark.createDataFrame([(n, t) for n, t in texts if n % 5 == 0], "n int, line string")
    hits = search.line_hits(lines, spark.createDataFrame(pairs, "needle_id int, needle string"), ["n"])
    got = [tuple(r) for r in hits.collect()]
    assert len(got) == len(set(got)) and {(n, n) for n in range(0, 1000, 5)} <= set(got)
    by_text = dict(texts)
    said = {}
    for k, p in pairs:
        said.setdefault(k, []).append(p)
    assert all(any(p in by_text[n] for p in said[k]) for k, n in got)


def test_lines_take_no_more_room_for_many_short_literals(spark):
    """Every line carried all grams that pass the filter: nearly one for each of its bytes where literals are short."""
    from hushscan.operators import search

    rng = random.Random(14)
    talk = [(i, " ".join(rng.choice(("in", "that", "ation", "to", "é", "whan", "ing")) + rng.choice(("", "er", "ed")) for _ in range(30))) for i in range(400)]
    lines = spark.createDataFrame(talk, "n int, line string")
    pairs = sorted({" ".join(t.split(" ")[:2]) for _, t in talk} | {" ".join(t.split(" ")[-2:]) for _, t in talk})
    needles = spark.createDataFrame([(p,) for p in pairs], "needle string")
    sizes, filters = search.window_filters(needles)
    left = search._window_digests(lines, ["n"], "line", sizes, next(filters), 0, search._md5).count()
    want = {(hashlib.md5(p.encode()).hexdigest(), n) for p in pairs for n, t in talk if p in t}
    assert left < 1.05 * len(want)
    assert {tuple(r) for r in search.line_hits(lines, needles, ["n"]).collect()} == want
