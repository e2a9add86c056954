"""Registered queries against their DuckDB statements on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from hushscan.plans.registry import QUERIES
from hushscan.plans.statements import STATEMENTS

SF = "/root/testdata/sf0.001"
CHECKED = [
    "detected_findings", "known_format_matches", "url_masked_text", "redacted_documents", "inline_markers",
    "baseline_former_kinds", "custom_rule_findings", "file_selection", "decoded_files", "history_first_seen",
    "severity_rollup", "sarif_results", "credentials", "leftover_references", "fix_plan", "line_reassembly",
    "alert_counts", "scrubbed_documents", "history_commits", "rotation_rollup", "sarif_log", "scan_files", "exclude_union",
    "baseline_round_trip", "rule_id_collisions", "history_limit", "lines_with_literals", "lines_with_many_literals",
    "scrubbed_events", "many_rule_findings", "contested_env_keys",
    "many_ignore_patterns", "stream_first_commits", "merged_sketches", "baseline_kept",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in found), key=repr)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["kind", "findings"]


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    frame = entry.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(columns)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert got == rows(columns, result.fetchall())
    assert got


def test_detection_reads_only_what_it_needs(spark):
    plan = entry.queries()["detected_findings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert plan.count("Generate explode") == 1


def test_tables_of_one_row_group_are_dealt_out_at_any_size(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from hushscan.plans import planted as PL

    monkeypatch.setattr(PL, "SMALL_BYTES", 0, raising=False)
    monkeypatch.setattr(PL, "PART_BYTES", 1 << 10, raising=False)
    ids = [*range(2000), None, 7]
    pq.write_table(pa.table({"doc_id": ids}), tmp_path / "documents.parquet")
    dealt = PL.evened(spark, str(tmp_path), "documents", "doc_id")
    rows = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) > 5 and max(r["count"] for r in rows) < 1000
    assert sorted(r["doc_id"] or -1 for r in dealt.collect()) == sorted(i or -1 for i in ids)
