"""Ignore lists as rows, kept baselines, mergeable counts and the first-commit table."""

import fnmatch
import random
import uuid

import pytest
from pyspark.sql import functions as F

from hushscan.functions import patterns as P
from hushscan.operators import baseline, history, ignore_index, sketches
from hushscan.operators.detect import finding_id
from hushscan.streaming import first_commits


def left(spark, paths, patterns):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "n long, path string")
    listed = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    return sorted(r.n for r in ignore_index.without_matched(rows, listed).collect())


def brute(paths, patterns):
    def hit(path):
        return any(fnmatch.fnmatchcase(path, p) or fnmatch.fnmatchcase(path.rpartition("/")[2], p) for p in patterns if p)

    return [i for i, path in enumerate(paths) if path is None or not hit(path)]


def test_patterns_against_brute_force(spark):
    draw = random.Random(3)
    pieces = ["src", "lib", "a", "b", ".py", "/", "long_common_name", "é", "😀", "[", "]", "-", "#", "."]
    wild = ["*", "?", "[ab]", "[!a]", "[!]", "[]a]", "**", "[a-z]*", "[z-a]", "[!z-a]", "[b-ac]", "[--b-d]", "[&&a|^~]"]
    paths = ["".join(draw.choices(pieces, k=draw.randint(1, 7))) for _ in range(400)] + [None, None, "", "src/a.py", "src/a.py"]
    for n in (1, 6, 40, 150):
        globs = ["".join(draw.choices(pieces + wild, k=draw.randint(2, 6))) for _ in range(n)]
        assert left(spark, paths, [*globs, None, "", *globs[:3]]) == brute(paths, [g for g in globs if g])


@pytest.mark.parametrize(
    "pattern, row",
    [
        ("a/b.py", ("whole", "a/b.py")), ("*.py", ("tail", ".py")), ("src/*", ("head", "src/")), ("*", ("any", "")), ("[ab]?", ("any", "")),
        ("source/*/test_?.py", ("head", "source/")), ("?/*_generated.py", ("tail", "_generated.py")), ("*a very long middle*", ("inner", "a very long ")),
    ],
)
def test_keys_of_patterns(pattern, row):
    assert ignore_index.index_row(pattern)[:2] == row


def test_patterns_of_nothing_and_everything(spark):
    paths = ["a", "b/c", "", None]
    assert left(spark, paths, []) == [0, 1, 2, 3]
    assert left(spark, paths, [None, ""]) == [0, 1, 2, 3]
    assert left(spark, paths, ["*"]) == [3]
    assert left(spark, [], ["*", "a"]) == []
    assert left(spark, paths, ["[z-a]", "a" * 5000]) == [0, 1, 2, 3]


def test_plan_does_not_grow_with_the_patterns(spark):
    paths = spark.range(50).select(F.concat(F.lit("src/f"), "id", F.lit(".py")).alias("path"))

    def size(n):
        listed = spark.range(n).select(F.concat(F.lit("*f"), F.format_string("%05d", "id"), F.lit(".p?")).alias("pattern"))
        return len(ignore_index.without_matched(paths, listed)._jdf.queryExecution().optimizedPlan().toString())

    assert abs(size(2) - size(5000)) < 200


FOUND = "source_id string, kind string, value string, finding_id string"


def test_kept_baseline(spark, tmp_path):
    kind = P.RECLASSIFIED_KINDS[0]
    rows = [("f%d" % (i % 7), "github_token", f"v{i}") for i in range(60)] + [("g", kind, f"w{i}") for i in range(10)]
    found = spark.createDataFrame(rows, "source_id string, kind string, value string").withColumn(
        "finding_id", finding_id(F.col("source_id"), F.col("kind"), F.col("value"))
    )
    former = finding_id(F.col("source_id"), F.lit(P.FORMER_KINDS[0]), F.col("value"))
    held = found.where("value in ('v1', 'v2', 'w3')").select("finding_id").union(found.where("value = 'w4'").select(former))
    kept = held.union(held).toDF("id").union(spark.createDataFrame([(None,)], "id string"))
    name = "kept_" + uuid.uuid4().hex
    baseline.keep_baseline(kept, name, str(tmp_path / "kept"), 4)
    try:
        for legacy in (True, False):
            want = sorted(r.value for r in baseline.new_findings(found, kept, legacy).collect())
            new = baseline.new_against_kept(found, name, legacy)
            assert sorted(r.value for r in new.collect()) == want and len(want) == (66 if legacy else 67)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = baseline.new_against_kept(found, name, legacy=False)._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("FileScan")]
        # the only exchange is on the findings' side of the join
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in scan[scan.rindex("Scan ExistingRDD") :]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")


def test_sketches_merge_over_slices(spark):
    rows = spark.range(60_000).select((F.col("id") % 40_000).alias("c"), (F.col("id") % 3).alias("day"), (F.col("id") % 2).alias("key"))
    rows = rows.union(spark.createDataFrame([(None, 0, 2)], "c long, day long, key long"))
    kept = sketches.sketch_counts(rows, "c", ("day", "key"))
    got = {r.key: r.n for r in sketches.estimates(sketches.merge_sketches(kept, ("key",))).collect()}
    bound = 4 * sketches.relative_error() * 20_000
    assert abs(got[0] - 20_000) < bound and abs(got[1] - 20_000) < bound and got[2] == 0
    few = sketches.estimates(sketches.sketch_counts(rows.where("c < 20"), "c", ("key",))).collect()
    assert sorted((r.key, r.n) for r in few) == [(0, 10), (1, 10)]


SEEN = "repo string, source_id string, kind string, finding_id string, commit string, rank long, hunk long, line int, start int"


def test_first_commits_survive_replay_and_compaction(spark, tmp_path):
    draw = random.Random(8)
    rows = [
        ("r%d" % draw.randint(0, 1), "f%d" % draw.randint(0, 3), "k", "id%d" % draw.randint(0, 5), f"c{(c := draw.randint(0, 20))}", c, draw.randint(0, 3), i, i)
        for i in range(300)
    ]
    batches = [spark.createDataFrame(rows[i : i + 60], SEEN) for i in range(0, 300, 60)]
    path = str(tmp_path / "table")

    def same(n):
        want = history.first_seen(spark.createDataFrame(rows[: 60 * n], SEEN), ("repo",))
        assert sorted(map(str, first_commits.first_commits(spark, path, ("repo",)).collect())) == sorted(map(str, want.collect()))

    assert first_commits.first_commits(spark, path, ("repo",)) is None
    first_commits.compact(spark, path, ("repo",))
    for n, batch in enumerate(batches[:3]):
        first_commits.record(batch, n, path, ("repo",))
        first_commits.record(batch, n, path, ("repo",))  # the batch is run again
        same(n + 1)
    first_commits.compact(spark, path, ("repo",))
    same(3)
    first_commits.record(batches[2], 2, path, ("repo",))  # run again after it was folded
    first_commits.record(batches[1].limit(0), 3, path, ("repo",))
    same(3)
    first_commits.record(batches[3], 4, path, ("repo",))
    (tmp_path / "table" / "batch-5").mkdir()  # a batch that broke off
    same(4)
    first_commits.compact(spark, path, ("repo",))
    first_commits.record(batches[4], 5, path, ("repo",))
    same(5)
    assert "value" not in first_commits.first_commits(spark, path, ("repo",)).columns


def test_pieces_of_paths_are_never_broadcast(spark, tmp_path, monkeypatch):
    """A long list met the exploded pieces of all paths in a broadcast, since their files are small."""
    from hushscan.operators import cluster

    monkeypatch.setattr(cluster, "BROADCAST_ROWS", 5)
    spark.range(40).selectExpr("id AS n", "concat('src/a', id, '/f', id, '.py') AS path").write.parquet(f"{tmp_path}/paths")
    spark.range(0, 40, 2).selectExpr("explode(array(concat('f', id, '.py'), concat('*/a', id, '/*.txt'))) AS pattern").write.parquet(f"{tmp_path}/list")
    left = ignore_index.matched_paths(spark.read.parquet(f"{tmp_path}/paths"), spark.read.parquet(f"{tmp_path}/list"))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(r.path for r in left.collect()) == sorted(f"src/a{i}/f{i}.py" for i in range(0, 40, 2))
