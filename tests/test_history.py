import samples

from hushscan.operators import history as H

AWS = dict(samples.POSITIVE)["aws_access_key_id"]
GH = "ghp_" + samples.BODY[:36]

PATCH = f"""@@commit c3
diff --git a/app.py b/app.py
index 1..2 100644
--- a/app.py
+++ b/app.py
@@ -0,0 +3 @@ def f():
+k = "{AWS}"
@@ -20,0 +25,2 @@
+a = 1
+b = "{GH}"
@@commit c2
diff --git a/app.py b/app.py
--- a/app.py
+++ b/app.py
@@ -7 +7 @@
--- x
+++ b/evil
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-k = "{AWS}"
diff --git a/old.py b/new.py
similarity index 100%
rename from old.py
rename to new.py
@@commit c1
diff --git a/app.py b/app.py
--- /dev/null
+++ b/app.py
@@ -0,0 +1,2 @@
+x = 1
+k = "{AWS}"
diff --git "a/q.py" "b/q.py"
--- /dev/null
+++ "b/q.py"
@@ -0,0 +1 @@
+k = "{GH}"
@@commit c0
"""


def lines(spark, text=PATCH, repo="r"):
    return spark.createDataFrame(
        [(repo, i, line) for i, line in enumerate(text.splitlines())], "repo string, line_no long, line string"
    )


def test_hunks(spark):
    for block in (2, 5, 1000):
        got = {
            (r.commit, r["rank"], r.path, r.first_line, r.text)
            for r in H.hunks_from_patch(lines(spark), block=block).collect()
        }
        assert got == {
            ("c3", 0, "app.py", 3, f'k = "{AWS}"\n'),
            ("c3", 0, "app.py", 25, f'a = 1\nb = "{GH}"\n'),
            ("c2", 1, "app.py", 7, "++ b/evil\n"),
            ("c1", 2, "app.py", 1, f'x = 1\nk = "{AWS}"\n'),
        }


def test_first_seen_is_the_oldest_commit(spark):
    hunks = H.hunks_from_patch(lines(spark), block=4)
    got = H.first_seen(H.history_findings(hunks)).drop("finding_id").collect()
    assert {tuple(r) for r in got} == {
        ("app.py", 2, "aws_access_key_id", "c1", 1),
        ("app.py", 26, "github_token", "c3", None),
    }


def test_limits(spark):
    annotated = H.annotate_patch(lines(spark))
    assert tuple(H.limit_reached(annotated, 2).first()) == (2, True)
    assert tuple(H.limit_reached(annotated, 4).first()) == (4, False)
    hunks = H.hunks_from_patch(lines(spark))
    assert {r.commit for r in H.newest(hunks, 2).collect()} == {"c3", "c2"}
    assert H.under_path(hunks, "app").count() == 0
    assert H.under_path(hunks, "app.py").count() == 4


def test_added_lines_have_new_line_numbers(spark):
    got = H.added_lines(H.annotate_patch(lines(spark), block=3)).select("new_line", "commit").collect()
    assert sorted((r.commit, r.new_line) for r in got) == [
        ("c1", 1), ("c1", 2), ("c2", 7), ("c3", 3), ("c3", 25), ("c3", 26),
    ]


def test_accept_filters_paths(spark):
    assert H.hunks_from_patch(lines(spark), accept=lambda p: p.rlike("js$")).count() == 0


def test_rank_ties_take_the_first_occurrence(spark):
    rows = [("f", 5, "c", 1, 9, 0, "k", "id"), ("f", 2, "c", 1, 4, 0, "k", "id")]
    df = spark.createDataFrame(rows, "source_id string, line int, commit string, rank long, hunk long, start int, kind string, finding_id string")
    assert H.first_seen(df).first()["line"] == 2


def plain_reader(lines_):
    """Line-by-line reading of one patch stream."""
    out, commit, path, start, added, in_hunk, rank = [], None, None, 0, [], False, -1

    def close():
        if path is not None and added:
            out.append((commit, rank, path, start, "\n".join(added) + "\n"))

    import re

    for line in lines_:
        found = re.match(H.HUNK_HEADER, line)
        if line.startswith("@@commit "):
            close()
            commit, rank, path, added, in_hunk = line[9:].strip(), rank + 1, None, [], False
        elif line.startswith("diff --git "):
            close()
            path, added, in_hunk = None, [], False
        elif found:
            close()
            start, added, in_hunk = int(found.group(1)), [], True
        elif not in_hunk and line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            path = name[2:] if name.startswith("b/") else None
        elif in_hunk and line.startswith("+"):
            added.append(line[1:])
    close()
    return out


def test_random_patches_equal_reading_in_order(spark):
    import random

    rng = random.Random(11)
    kinds = ["@@commit c%d", "diff --git a/f%d b/f%d", "--- a/f%d", "+++ b/f%d", "+++ /dev/null", "@@ -1 +%d @@",
             "@@ bad %d", "+added %d", "-gone %d", " same", "\\ No newline", "+++ b/t%d\tx", "+", "--- x"]
    repos = {}
    for r in range(4):
        seq = []
        for i in range(300):
            k = rng.choices(kinds, weights=[1, 2, 2, 4, 1, 4, 1, 6, 2, 2, 1, 1, 1, 1])[0]
            seq.append(k.replace("%d", str(i if "commit" in k else rng.randint(0, 5))))
        repos[f"r{r}"] = seq
    df = spark.createDataFrame(
        [(r, i * 3, line) for r, seq in repos.items() for i, line in enumerate(seq)],
        "repo string, line_no long, line string",
    ).repartition(3)
    for block in (4, 50, 10_000):
        got = {}
        for h in H.hunks_from_patch(df, block=block).collect():
            got.setdefault(h.repo, []).append((h.commit, h["rank"], h.path, h.first_line, h.text))
        for r, seq in repos.items():
            assert sorted(got.get(r, []), key=repr) == sorted(plain_reader(seq), key=repr), (r, block)


def test_sparse_line_numbers_and_a_long_hunk(spark):
    """Timestamps as line numbers: ranges hold about equally many lines, and one hunk spans many."""
    from pyspark.sql import functions as F

    from hushscan.operators.ordered import range_of, range_starts

    n, gap = 20_000, 7_919_000_000
    head = ["@@commit c1", "diff --git a/big b/big", "--- a/big", "+++ b/big", "@@ -0,0 +1 @@"]
    early = spark.createDataFrame([("r", i - 5, line) for i, line in enumerate(head)], "repo string, line_no long, line string")
    body = spark.range(n).select(F.lit("r").alias("repo"), (F.col("id") * gap).alias("line_no"), F.format_string("+line %d", "id").alias("line"))
    df = early.unionByName(body).repartition(5)
    starts = range_starts(df, ["repo", "line_no"], 1000)
    sizes = [r["count"] for r in df.groupBy(range_of(df, ["repo", "line_no"], starts).alias("b")).count().collect()]
    assert 15 <= len(sizes) <= 22 and max(sizes) < 3000 and sum(sizes) == n + 5
    annotated = H.annotate_patch(df, block=1000)
    assert annotated.select("block").distinct().count() == len(sizes)
    added = H.added_lines(annotated)
    wrong = added.where(F.concat(F.lit("line "), F.col("new_line") - 1) != F.col("text")).count()
    assert added.count() == n and wrong == 0
    (hunk,) = H.hunks_from_annotated(annotated).collect()
    assert hunk.text == "".join(f"line {i}\n" for i in range(n)) and hunk.commit == "c1"


def test_carry_forward_over_any_order(spark):
    from pyspark.sql import functions as F

    from hushscan.operators.ordered import carry_forward

    import random

    rng = random.Random(3)
    rows = [(g, rng.choice([0, 10**6]) * i + i - 50, rng.choice([None, i])) for g in ("a", "b", None) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, at long, v int").repartition(4)
    for block in (7, 1000):
        got = carry_forward(df, ["g"], "at", {"seen": F.col("v")}, {"sum": F.col("v")}, block).collect()
        by = {(r.g, r["at"]): (r.seen, r["sum"]) for r in got}
        for g in ("a", "b"):
            seen, total = None, 0
            for _, at, v in sorted(r for r in rows if r[0] == g):
                seen, total = (seen if v is None else v), total + (v or 0)
                assert by[g, at] == (seen, total)
