"""Change history: patch lines -> hunks -> first appearance of a credential."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from hushscan.operators.cluster import materialise
from hushscan.operators.detect import DEFAULT, explode_findings, scan_texts
from hushscan.operators.ordered import BLOCK, range_of, range_starts
from hushscan.options import Options

# --- Fixed values: the patch dialect --------------------------------------------
COMMIT_PREFIX = "@@commit "
FILE_PREFIX = "diff --git "
TARGET_PREFIX = "+++ "
HUNK_HEADER = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@"


def annotate_patch(
    lines: DataFrame,
    repo: str = "repo",
    line_no: str = "line_no",
    line: str = "line",
    commit_prefix: str = COMMIT_PREFIX,
    block: int = BLOCK,
) -> DataFrame:
    """Give each patch line its commit, rank (0 = newest), path and hunk.

    Content lines start with ``+``, ``-``, space or ``\\``, so commit, file and
    hunk headers are recognisable anywhere; a target header counts only outside
    a hunk, where it cannot be an added line.  Line numbers only order the
    lines: they may be sparse, timestamps for instance.  ``block`` is the range
    of about ``block`` lines that a line was read in.
    """
    rows = lines.select(
        F.col(repo).alias("repo"), F.col(line_no).cast("long").alias("line_no"),
        F.rtrim(F.col(line), F.lit("\n")).alias("line"),
    )
    keys = ["repo", "line_no"]
    place = range_of(rows, keys, range_starts(rows, keys, block))
    text = F.col("line")
    is_commit = F.startswith(text, F.lit(commit_prefix))
    is_file = F.startswith(text, F.lit(FILE_PREFIX))
    start = F.regexp_extract(text, HUNK_HEADER, 1)
    is_hunk = start != ""
    rows = rows.select(
        "*",
        place.alias("_block"),
        is_commit.alias("is_commit"),
        (is_commit | is_file | is_hunk).alias("is_header"),
        F.when(
            is_commit | is_file | is_hunk,
            F.struct(
                is_hunk.alias("in_hunk"),
                F.col("line_no").alias("at"),
                F.when(is_hunk, start.cast("int")).alias("start"),
            ),
        ).alias("header"),
        F.when(
            is_commit, F.trim(text.substr(F.lit(len(commit_prefix) + 1), F.length(text)))
        ).alias("commit"),
        _target(text, is_commit | is_file).alias("target"),
    )
    local = _within_blocks(rows)
    rows = local.join(_entering(local), ["repo", "_block"], "left")
    header = F.coalesce("at_header", "in_header")
    path = F.coalesce("at_sure", F.when(_outside(F.col("in_header")), F.col("at_open")), "in_target")
    rows = rows.select(
        "repo", "line_no", "line", "is_header", F.col("_block").alias("block"),
        F.coalesce("at_commit", "in_commit").alias("commit"),
        (F.col("at_commits") + F.coalesce("in_commits", F.lit(0))).alias("commits"),
        header.alias("header"),
        path.alias("target"),
    )
    return rows.select(
        "repo",
        "line_no",
        "line",
        "commit",
        (F.col("commits") - 1).alias("rank"),
        F.col("target.path").alias("path"),
        F.when(F.col("header.in_hunk"), F.col("header.at")).alias("hunk"),
        F.col("header.start").alias("first_line"),
        "is_header",
        "block",
    )


def _target(text: Column, reset: Column) -> Column:
    """Path event of a line: a target header names a file, a reset forgets it."""
    name = F.substring_index(text.substr(F.lit(len(TARGET_PREFIX) + 1), F.length(text)), "\t", 1)
    path = F.when(F.startswith(name, F.lit("b/")), name.substr(F.lit(3), F.length(name)))
    return F.when(reset, F.struct(F.lit(None).cast("string").alias("path"))).when(
        F.startswith(text, F.lit(TARGET_PREFIX)), F.struct(path.alias("path"))
    )


def _within_blocks(rows: DataFrame) -> DataFrame:
    """State at each row as far as its own block of lines tells.

    Whether a ``+++`` line is a header depends on the last header before it.
    Where that lies in an earlier block the line stays *open* and is settled by
    the state entering the block.
    """
    so_far = (
        Window.partitionBy("repo", "_block")
        .orderBy("line_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    state = rows.select(
        "*",
        F.last("header", True).over(so_far).alias("at_header"),
        F.last("commit", True).over(so_far).alias("at_commit"),
        F.sum(F.col("is_commit").cast("long")).over(so_far).alias("at_commits"),
    )
    sure = F.col("is_header") | (F.col("at_header").isNotNull() & ~F.col("at_header.in_hunk"))
    return state.select(
        "*",
        F.last(F.when(sure, F.col("target")), True).over(so_far).alias("at_sure"),
        F.last(F.when(F.col("at_header").isNull(), F.col("target")), True).over(so_far).alias("at_open"),
    )


def _entering(local: DataFrame) -> DataFrame:
    """State entering each block: one row per block travels along the history.

    ``local`` are the lines with their in-block state; the state at a block's
    last line is the block's summary, also of blocks without any header.
    """
    ends = local.groupBy("repo", "_block").agg(
        F.max_by(F.struct("at_header", "at_commit", "at_commits", "at_sure", "at_open"), "line_no").alias("end")
    )
    before = Window.partitionBy("repo").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    chain = ends.select("repo", "_block", "end.*").select(
        "*",
        F.last("at_header", True).over(before).alias("in_header"),
        F.last("at_commit", True).over(before).alias("in_commit"),
        F.sum("at_commits").over(before).alias("in_commits"),
    )
    settled = F.coalesce("at_sure", F.when(_outside(F.col("in_header")), F.col("at_open")))
    return chain.select(
        "repo", "_block", "in_header", "in_commit", "in_commits",
        F.last(settled, True).over(before).alias("in_target"),
    )


def _outside(header: Column) -> Column:
    return header.isNull() | ~header["in_hunk"]


def _added(annotated: DataFrame, accept: Callable[[Column], Column] | None) -> DataFrame:
    added = annotated.where(
        F.col("hunk").isNotNull()
        & F.col("path").isNotNull()
        & ~F.col("is_header")
        & F.startswith("line", F.lit("+"))
    )
    return added.where(accept(F.col("path"))) if accept is not None else added


def added_lines(annotated: DataFrame, accept: Callable[[Column], Column] | None = None) -> DataFrame:
    """Added lines of named files, with their line number in the new version.

    A hunk is numbered in its blocks at once; only the number of added lines
    of each block travels along a hunk.
    """
    added = _added(annotated, accept)
    part = ["repo", "hunk", "block"]
    earlier = Window.partitionBy("repo", "hunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = added.groupBy(*part).agg(F.count(F.lit(1)).alias("_here"))
    ahead = counts.select(*part, F.sum("_here").over(earlier).alias("_ahead")).where(F.col("_ahead").isNotNull())
    in_block = F.row_number().over(Window.partitionBy(*part).orderBy("line_no"))
    return added.withColumn("_nth", in_block).join(ahead, part, "left").select(
        "repo", "commit", "rank", "path", "hunk", "first_line", "line_no",
        (F.col("first_line") + F.coalesce("_ahead", F.lit(0)) + F.col("_nth") - 1).cast("int").alias("new_line"),
        F.col("line").substr(F.lit(2), F.length("line")).alias("text"),
    )


def hunks_from_patch(
    lines: DataFrame,
    accept: Callable[[Column], Column] | None = None,
    commit_prefix: str = COMMIT_PREFIX,
    block: int = BLOCK,
    **columns: str,
) -> DataFrame:
    """One text per hunk: (repo, commit, rank, path, hunk, first_line, text)."""
    annotated = annotate_patch(lines, commit_prefix=commit_prefix, block=block, **columns)
    return hunks_from_annotated(annotated, accept)


def hunks_from_annotated(
    annotated: DataFrame, accept: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Put the added lines of each hunk together."""
    added = _added(annotated, accept).withColumn("text", F.col("line").substr(F.lit(2), F.length("line")))
    body = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return added.groupBy("repo", "commit", "rank", "path", "hunk", "first_line").agg(
        F.concat(F.array_join(F.transform(body, lambda b: b["text"]), "\n"), F.lit("\n")).alias("text")
    )


def newest(hunks: DataFrame, commits: int) -> DataFrame:
    """Hunks of the newest ``commits`` commits."""
    return hunks.where(F.col("rank") < commits)


def limit_reached(ranked: DataFrame, commits: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """Per ``scope`` (default: one row): commits scanned, and whether there are more beyond the limit."""
    return ranked.groupBy(*scope).agg(
        F.least(F.coalesce(F.max("rank") + 1, F.lit(0)), F.lit(commits)).cast("long").alias("commits_scanned"),
        F.coalesce(F.max("rank") >= commits, F.lit(False)).alias("max_commits_reached"),
    )


def under_path(hunks: DataFrame, path: str) -> DataFrame:
    """History limited to a file or a directory."""
    path = path.rstrip("/")
    if path in ("", "."):
        return hunks
    return hunks.where((F.col("path") == path) | F.startswith("path", F.lit(path + "/")))


def history_findings(hunks: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """Detection per hunk, with line numbers in the new version of the file."""
    keep = [c for c in ("repo", "commit", "rank", "hunk", "first_line") if c in hunks.columns]
    first_line = "first_line" if "first_line" in keep else None
    return explode_findings(scan_texts(hunks, "path", "text", options, keep), keep, first_line)


def first_seen(findings: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The oldest appearance of each (file, kind, value) and how many other commits hold it.

    Grouped by fingerprint, so no value is shuffled; both aggregates combine
    before the shuffle, so a credential present everywhere is no hot task.
    On equal rank the earliest hunk and offset wins.
    """
    tie = F.col("hunk") if "hunk" in findings.columns else F.col("first_line")
    oldest = F.max_by(
        F.struct("line", "commit", "rank"),
        F.struct("rank", (-tie).alias("h"), (-F.col("start")).alias("s")),
    )
    grouped = findings.groupBy(*scope, "source_id", "kind", "finding_id").agg(
        oldest.alias("first"), (F.count_distinct("commit") - 1).alias("others")
    )
    return grouped.select(
        *scope,
        F.col("source_id").alias("file"),
        F.col("first.line").alias("line"),
        "kind",
        F.col("first.commit").alias("commit"),
        F.nullif("others", F.lit(0)).alias("also_in_commits"),
        "finding_id",
    )


def in_history_order(first: DataFrame) -> DataFrame:
    """Report order; written out first, since sorting reads its input twice."""
    return materialise(first).orderBy("file", "line", "kind")
