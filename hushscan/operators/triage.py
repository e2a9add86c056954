"""From findings to a rotation worklist: credentials, providers, leftover copies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hushscan.functions import catalog as K, patterns as P
from hushscan.functions.folds import bind, running
from hushscan.functions.spans import newline_count
from hushscan.operators.cluster import broadcast_if_small, hold, materialise
from hushscan.operators.history import COMMIT_PREFIX
from hushscan.operators.search import line_hits, lines_of

SHOWN = 5
#: what ends a line inside a credential of several lines
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


# --- the credential inside a match ---------------------------------------------------


def core_value(kind: Column, value: Column) -> Column:
    """The part of a match that is the credential itself."""
    runs = F.regexp_extract_all(value, F.lit("[A-Za-z0-9/+=]{40}"), F.lit(0))
    secret = F.coalesce(F.get(runs, F.size(runs) - 1), value)
    bare = F.regexp_replace(value, "(?idsU)^bearer" + P.WS + "+", "")
    return (
        F.when(kind == "aws_secret_access_key", secret)
        .when(kind == "bearer_token", bare)
        .otherwise(value)
    )


def history_needle(core: Column) -> Column:
    """A single line standing for the credential: its longest body line if it has several."""
    edge = f"(?U)^{P.WS}+|{P.WS}+$"
    strip = lambda c: F.regexp_replace(c, edge, "")
    body = F.filter(
        F.transform(
            F.filter(F.split(core, LINE_ENDS), lambda l: ~F.startswith(l, F.lit("-----"))), strip
        ),
        lambda l: l != "",
    )
    longest = F.aggregate(
        body, F.lit(""), lambda best, l: F.when(F.length(l) > F.length(best), l).otherwise(best)
    )
    multi = bind(longest, lambda l: F.when(l != "", l).otherwise(strip(core)))
    return F.when(F.contains(core, F.lit("\n")), multi).otherwise(core)


# --- provider lookup ------------------------------------------------------------------


def provider_catalog(spark: SparkSession) -> DataFrame:
    """One row per kind with its variants, longest prefix first."""
    grouped: dict[str, list[dict]] = {}
    for p in K.PROVIDERS:
        grouped.setdefault(p.kind, []).append(
            dict(prefix=p.prefix, provider=p.provider, credential=p.credential,
                 needs_rotation=p.needs_rotation, manage_url=p.manage_url, docs=list(p.docs))
        )
    rows = [
        {"kind": kind, "variants": sorted(v, key=lambda x: -len(x["prefix"]))}
        for kind, v in grouped.items()
    ]
    variant = pa.struct(
        [("prefix", pa.string()), ("provider", pa.string()), ("credential", pa.string()),
         ("needs_rotation", pa.bool_()), ("manage_url", pa.string()), ("docs", pa.list_(pa.string()))]
    )
    schema = pa.schema([("kind", pa.string()), ("variants", pa.list_(variant))])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def has_builtin_format(kind: Column, value: Column) -> Column:
    """The value really has the format of its kind (a custom rule may borrow the name)."""
    check = F.lit(False)
    for p in dict.fromkeys(p.kind for p in K.PROVIDERS):
        check = F.when(kind == p, value.rlike(P.RULE_BY_KIND[p].java)).otherwise(check)
    return check


def identify(findings: DataFrame) -> DataFrame:
    """Add provider, credential, needs_rotation, manage_url, docs, identified, steps.

    The provider table is a constant of a few rows, so broadcasting it is safe.
    """
    dim = F.broadcast(
        provider_catalog(findings.sparkSession).select(F.col("kind").alias("_kind"), "variants")
    )
    joined = findings.join(dim, F.col("kind") == F.col("_kind"), "left")
    chosen = F.when(
        has_builtin_format(F.col("kind"), F.col("value")),
        F.get(F.filter("variants", lambda v: F.startswith(F.col("value"), v["prefix"])), F.lit(0)),
    )
    generic = F.lit(K.GENERIC_CREDENTIAL)
    for kind, name in K.GENERIC_CREDENTIALS.items():
        generic = F.when(F.col("kind") == kind, F.lit(name)).otherwise(generic)
    steps = {k: F.array(*[F.lit(s) for s in v]).cast("array<string>") for k, v in K.ROTATION_STEPS.items()}
    out = joined.withColumn("_p", chosen)
    identified = F.col("_p").isNotNull()
    return out.select(
        *findings.columns,
        F.coalesce("_p.provider", F.lit(K.UNKNOWN)).alias("provider"),
        F.coalesce("_p.credential", generic).alias("credential"),
        F.coalesce("_p.needs_rotation", F.lit(True)).alias("needs_rotation"),
        F.col("_p.manage_url").alias("manage_url"),
        F.col("_p.docs").alias("docs"),
        identified.alias("identified"),
        F.when(identified & ~F.col("_p.needs_rotation"), steps["none"])
        .when(identified, steps["provider"])
        .when(F.col("kind") == "private_key_block", steps["private_key_block"])
        .otherwise(steps["unknown"])
        .alias("steps"),
    )


# --- credentials ------------------------------------------------------------------------


def credentials(findings: DataFrame) -> DataFrame:
    """One row per distinct credential, however many copies there are.

    Copies are first reduced to one row per (credential, file, line), combined
    before the shuffle and spread over all tasks; only counts, the first location
    and a bounded list of the first few are kept per credential, so a credential
    found in a third of all rows stays a small group.
    """
    kind, value = F.col("kind"), F.col("value")
    keyed = findings.select(
        F.col("source_id").alias("file"),
        "line",
        "start",
        F.struct("kind", "value").alias("match"),
        (~has_builtin_format(kind, value)).alias("unknown"),
        F.sha2(core_value(kind, value), 256).alias("credential_id"),
    )
    # the first identified match speaks for the credential, else the first one
    first = F.struct("unknown", "start")
    places = hold(
        keyed.groupBy("credential_id", "file", "line").agg(
            F.min_by("match", first).alias("match"), F.min(first).alias("first")
        )
    )
    place = F.struct("file", "line")
    heads = places.groupBy("credential_id").agg(
        F.min_by("match", F.struct("first.unknown", "file", "line", "first.start")).alias("match"),
        F.min(place).alias("first_location"),
        F.count(F.lit(1)).alias("n_locations"),
    )
    # `<= SHOWN` is applied before the shuffle too (Spark's window group limit)
    nth = F.row_number().over(Window.partitionBy("credential_id").orderBy("file", "line"))
    shown = (
        places.select("credential_id", "file", "line")
        .withColumn("nth", nth)
        .where(F.col("nth") <= SHOWN)
        .groupBy("credential_id")
        .agg(F.array_sort(F.collect_list(place)).alias("locations"))
    )
    found = heads.join(shown, "credential_id").select(
        "credential_id",
        "match.kind",
        "match.value",
        core_value(F.col("match.kind"), F.col("match.value")).alias("core"),
        "first_location",
        "locations",
        "n_locations",
        F.greatest(F.col("n_locations") - SHOWN, F.lit(0)).alias("more_locations"),
    )
    return identify(found)


def in_first_seen_order(creds: DataFrame) -> DataFrame:
    return creds.orderBy("first_location")


def credential_locations(findings: DataFrame) -> DataFrame:
    """Every (credential, file, line), as rows."""
    core = core_value(F.col("kind"), F.col("value"))
    return findings.select(
        F.sha2(core, 256).alias("credential_id"), F.col("source_id").alias("file"), "line"
    ).distinct()


# --- leftover copies ----------------------------------------------------------------------


def _needles(creds: DataFrame) -> DataFrame:
    return hold(
        creds.select(
            "credential_id", "core", history_needle(F.col("core")).alias("needle")
        ).where(F.length("needle") > 0)
    )


def _line_literals(needles: DataFrame) -> DataFrame:
    """Distinct single-line literals; a needle never spans lines."""
    return hold(
        needles.select(F.sha2("needle", 256).alias("needle_id"), "needle").distinct()
    )


def _core_lines(text: Column, core: Column) -> Column:
    """1-based start lines of the non-overlapping occurrences of ``core``."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(core, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    gaps = F.split(text, quoted, -1)
    inside = newline_count(core)
    starts = lambda pieces: running(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.lit(1),
        lambda at, gap: at + newline_count(gap) + inside,
        lambda at, gap: F.array(at + newline_count(gap)),
        "int",
    )
    return bind(gaps, starts)


def references(creds: DataFrame, texts: DataFrame, source_id: str = "source_id", text: str = "text") -> DataFrame:
    """Every distinct (credential, file, line) where the credential itself occurs."""
    needles = _needles(creds)
    sources = texts.select(F.col(source_id).cast("string").alias("file"), F.col(text).alias("text"))
    hits = materialise(
        line_hits(lines_of(sources, ["file"]), _line_literals(needles), ["file", "line_no"])
    )
    keyed = needles.withColumn("needle_id", F.sha2("needle", 256))
    whole = F.col("core") == F.col("needle")
    single = keyed.where(whole).select("credential_id", "needle_id")
    direct = hits.join(single, "needle_id").select(
        "credential_id", "file", F.col("line_no").cast("int").alias("line")
    )
    # several-line credentials: the body line gave candidate texts, the block decides
    blocks = keyed.where(~whole).select("credential_id", "needle_id", "core")
    pairs = hold(hits.select("needle_id", "file").distinct().join(blocks, "needle_id"))
    located = (
        sources.join(broadcast_if_small(pairs, "core", "file"), "file")
        .where(F.contains("text", F.col("core")))
        .select("credential_id", "file", F.explode(_core_lines(F.col("text"), F.col("core"))).alias("line"))
    )
    return direct.unionAll(located).distinct()


def history_commits(creds: DataFrame, patch_lines: DataFrame, commit_prefix: str = COMMIT_PREFIX) -> DataFrame:
    """Every distinct (credential, repo, commit, rank) with a diff line containing the credential.

    ``patch_lines`` holds all lines of the patches (added, removed, context)
    with ``repo``, ``line_no``, ``commit``, ``rank`` and ``line``; lines that
    start with ``commit_prefix`` are headers.
    """
    needles = _needles(creds)
    body = patch_lines.where(F.col("commit").isNotNull() & ~F.startswith("line", F.lit(commit_prefix)))
    hits = line_hits(body, _line_literals(needles), ["repo", "line_no", "commit", "rank"])
    ids = needles.select("credential_id", F.sha2("needle", 256).alias("needle_id"))
    commits = hits.select("needle_id", "repo", "commit", "rank").distinct().join(ids, "needle_id")
    return commits.select("credential_id", "repo", "commit", "rank").distinct()


def history_references(creds: DataFrame, patch_lines: DataFrame, commit_prefix: str = COMMIT_PREFIX) -> DataFrame:
    """Per credential: how many commits show it, and the newest few (``history_commits`` has them all)."""
    commits = materialise(history_commits(creds, patch_lines, commit_prefix))
    nth = F.row_number().over(Window.partitionBy("credential_id").orderBy("rank", "repo", "commit"))
    shown = (
        commits.withColumn("nth", nth)
        .where(F.col("nth") <= SHOWN)
        .groupBy("credential_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("nth", "commit"))),
                lambda c: F.substring(c["commit"], 1, 8),
            ).alias("commits")
        )
    )
    counts = commits.groupBy("credential_id").agg(F.count(F.lit(1)).alias("history_commits"))
    return counts.join(shown, "credential_id")


# --- worklist -----------------------------------------------------------------------------


def worklist(
    creds: DataFrame,
    refs: DataFrame | None = None,
    status: DataFrame | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Credentials with what remains to be done.

    Resolved means: reported revoked (``status`` rows ``credential_id, revoked``)
    and no copy left, or a credential that needs no rotation.  It repeats what a
    person reported and what was found; nothing is verified with a provider.
    """
    out = creds
    if refs is not None:
        left = refs.groupBy("credential_id").agg(F.count(F.lit(1)).alias("_refs"))
        out = out.join(left, "credential_id", "left").withColumn(
            "refs_remaining", F.coalesce("_refs", F.lit(0).cast("long"))
        ).drop("_refs")
    else:
        out = out.withColumn("refs_remaining", F.lit(None).cast("long"))
    if status is not None:
        told = status.groupBy("credential_id").agg(F.bool_or("revoked").alias("revoked_reported"))
        out = out.join(told, "credential_id", "left")
    else:
        out = out.withColumn("revoked_reported", F.lit(None).cast("boolean"))
    if history is not None:
        counts = history.select("credential_id", F.col("history_commits").alias("_commits"))
        out = out.join(counts, "credential_id", "left").withColumn(
            "history_commits", F.coalesce("_commits", F.lit(0).cast("long"))
        ).drop("_commits")
    done = F.coalesce(F.col("revoked_reported") & (F.col("refs_remaining") == 0), F.lit(False))
    return out.withColumn("resolved", ~F.col("needs_rotation") | done)


def rollup(work: DataFrame) -> DataFrame:
    """One row: credentials, still unresolved, and those needing no rotation."""
    return work.agg(
        F.count(F.lit(1)).alias("credentials"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
        F.count_if(~F.col("needs_rotation")).alias("no_rotation_needed"),
        F.coalesce(F.sum("refs_remaining"), F.lit(0)).alias("refs_remaining"),
    )
