"""Redaction of flat, nested and semi-structured columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hushscan.functions import patterns as P, redaction
from hushscan.functions.folds import bind
from hushscan.operators.detect import DEFAULT, redact_column
from hushscan.operators.cluster import hold, never_broadcast
from hushscan.operators.search import candidates, digest, gram_filter, needle_grams, with_grams
from hushscan.options import Options


def redact_texts(
    df: DataFrame,
    text: str = "text",
    options: Options = DEFAULT,
    flag: str | None = "was_redacted",
) -> DataFrame:
    """Replace one text column by its redacted form, with a flag column."""
    if not options.enabled:
        return df.withColumn(flag, F.lit(False)) if flag else df
    out = df.withColumn("_redacted", redact_column(text, options))
    out = out.withColumn(text, F.col("_redacted.text"))
    if flag:
        out = out.withColumn(flag, F.col("_redacted.redacted"))
    return out.drop("_redacted")


def _has_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_strings(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_strings(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_strings(f.dataType) for f in kind.fields)
    return False


def redact_value(value: Column, kind: T.DataType, options: Options = DEFAULT) -> Column:
    """Redact every string inside a nested value, each one on its own.

    Map keys and non-string leaves stay as they are.
    """
    if not _has_strings(kind):
        return value
    if isinstance(kind, T.StringType):
        return bind(
            value,
            lambda v: redaction.redact(v, options.entropy_threshold, options.mask)["text"],
        )
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: redact_value(v, kind.elementType, options))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: redact_value(v, kind.valueType, options))
    fields = [
        redact_value(value[f.name], f.dataType, options).alias(f.name) for f in kind.fields
    ]
    return F.when(value.isNotNull(), F.struct(*fields))


def redact_nested(
    df: DataFrame, columns: Sequence[str] | None = None, options: Options = DEFAULT
) -> DataFrame:
    """Redact the named columns (default: every column holding strings)."""
    if not options.enabled:
        return df
    names = columns if columns is not None else df.columns
    out = []
    for f in df.schema.fields:
        chosen = f.name in names and _has_strings(f.dataType)
        value = redact_value(F.col(f.name), f.dataType, options) if chosen else F.col(f.name)
        out.append(value.alias(f.name))
    return df.select(*out)


def scrub_literals(values: DataFrame, column: str = "value", min_length: int = 6, min_line: int = 12) -> DataFrame:
    """Distinct literals to hide for a table of known values: ``needle_id``, ``needle``.

    Values of ``min_length`` characters or more, and the stripped lines of
    several-line values from ``min_line`` characters on.
    """
    value = F.col(column)
    lines = F.transform(F.split(value, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda l: F.regexp_replace(l, r"(?U)^\s+|\s+$", ""))
    found = F.concat(
        F.filter(F.array(value), lambda v: F.length(v) >= min_length),
        F.when(F.contains(value, F.lit("\n")), F.filter(lines, lambda l: F.length(l) >= min_line)).otherwise(
            F.array().cast("array<string>")
        ),
    )
    rows = values.where(value.isNotNull()).select(F.explode(found).alias("needle")).distinct()
    return rows.select(F.sha2("needle", 256).alias("needle_id"), "needle")


def scrub_texts(texts: DataFrame, literals: DataFrame, text: str = "text", mask: str = P.DEFAULT_MASK) -> DataFrame:
    """Replace the literals of a table in every text, the longest first, equally long ones in code point order.

    A literal counts if it occurs in the text as given.  Texts that share no
    gram with any literal stay where they are; the others meet their literals
    in a join, once per distinct text, by its digest.  ``literals`` are
    ``(needle_id, needle)`` rows; they and ``texts`` are read more than once.
    Null texts stay null.
    """
    words = literals.select("needle").where("needle <> ''").distinct().withColumn("key", digest("needle"))
    grams = hold(needle_grams(words, "key"))
    bitmap, tiers = gram_filter(grams)
    marked = with_grams(texts, text, bitmap, tiers)
    untouched = marked.where(F.col("_grams").isNull()).drop("_grams")
    touched = hold(marked.where(F.col("_grams").isNotNull()).withColumn("_digest", digest(F.col(text))))
    # copies of a text are put together before anything is shuffled
    whole = touched.groupBy("_digest").agg(F.first(text).alias("_text"), F.first("_grams").alias("_grams"))
    met = candidates(whole.select("_digest", "_grams"), grams, ["_digest"]).join(never_broadcast(words), "key")
    sure = met.join(never_broadcast(whole.select("_digest", "_text")), "_digest").where(F.contains("_text", F.col("needle")))
    order = F.array_sort(F.collect_list(F.struct((-F.length("needle")).alias("n"), "needle")))
    found = sure.groupBy("_digest").agg(order.alias("_found"))
    hidden = F.aggregate(
        F.coalesce("_found", F.array().cast("array<struct<n:int,needle:string>>")),
        F.col(text),
        lambda out, f: F.replace(out, f["needle"], F.lit(mask)),
    )
    scrubbed = touched.drop("_grams").join(never_broadcast(found), "_digest", "left").withColumn(text, hidden)
    return untouched.unionByName(scrubbed.select(*texts.columns))
