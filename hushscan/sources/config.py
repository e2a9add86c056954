"""Small configuration inputs: ignore lists, rule files, baselines."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from hushscan.operators.baseline import to_baseline
from hushscan.operators.rules import RuleSet, compile_rules
from hushscan.options import Options

_BASELINE = "id string, file string, kind string, line int"


def ignore_patterns(lines: DataFrame, column: str = "value") -> DataFrame:
    """Pattern rows of an ignore list: blanks and ``#`` out, ``dir/`` means its contents."""
    line = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    return (
        lines.select(line.alias("pattern"))
        .where((F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#")))
        .select(F.regexp_replace("pattern", "/$", "/*").alias("pattern"))
    )


def exclude_patterns(
    flags: Iterable[str] = (), options: Options = Options(), ignore: DataFrame | None = None
) -> tuple[str, ...]:
    """Union of the pattern sources, ready for a path predicate.

    Patterns are configuration that becomes part of the plan: however many
    there are, all count.
    """
    patterns = [*flags, *options.ignore_paths]
    if ignore is not None:
        patterns += sorted(r["pattern"] for r in ignore.select("pattern").distinct().toLocalIterator())
    return tuple(dict.fromkeys(patterns))


def load_rules(spark: SparkSession, path: str | Path) -> RuleSet:
    """Rules of a TOML file; a missing or empty file is a valid, empty set."""
    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return RuleSet((), ())
    except (OSError, ValueError) as problem:
        return RuleSet((), ((None, None, f"unreadable rules file: {type(problem).__name__}"),))
    return compile_rules(spark, data.get("rules"))


def _baseline_rows(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    shape, options = f"{_BASELINE}, malformed string", {"columnNameOfCorruptRecord": "malformed"}
    return spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", shape, options).alias("r")).select("r.*")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Accepted findings from JSON rows or one document with a ``findings`` array.

    A missing file is an empty baseline.  Rows that are no JSON accept nothing;
    ``malformed_baseline_rows`` has them.
    """
    rows = _baseline_rows(spark, path)
    if rows is None:
        return spark.createDataFrame([], _BASELINE)
    # newline-delimited rows first; whole documents only when that is not the shape
    known = rows.where("id is not null and malformed is null").drop("malformed")
    if not known.isEmpty():
        return known
    entry = _BASELINE.replace(" ", ":").replace(",:", ",")
    document = spark.read.schema(f"findings array<struct<{entry}>>").option("multiLine", "true").json(path)
    return document.select(F.inline("findings")).where("id is not null")


def malformed_baseline_rows(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a baseline of JSON rows that cannot be read: (malformed)."""
    rows = _baseline_rows(spark, path)
    if rows is None:
        return spark.createDataFrame([], "malformed string")
    return rows.select("id", "malformed").where("malformed is not null").select("malformed")


def write_baseline(findings: DataFrame, path: str) -> None:
    """Replace the baseline by all current findings (ids, files, kinds, lines)."""
    to_baseline(findings).write.mode("overwrite").json(path)
