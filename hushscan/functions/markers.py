"""Inline suppression markers parsed from a text, as a Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hushscan.functions.patterns import WS

MARKER = "struct<line:int,all_kinds:boolean,kinds:array<string>>"


def _marker_regex(prefix: str) -> str:
    literal = r"\Q" + prefix + r"\E" if prefix else ""
    return "(?U)" + literal + r"[ \t]*ignore(-next-line)?(?![\w-])(?:\[([^\]\r\n]*)\])?"


def parse_markers(text: Column, prefix: str) -> Column:
    """One entry per marker: the line it targets, and every kind or a kind list.

    Lines end at ``\\n`` only.  ``[]`` is a list that names nothing; an unclosed
    bracket is read as no list at all.
    """
    regex = _marker_regex(prefix)

    def one(found: Column, line: Column) -> Column:
        bracketed = F.endswith(found, F.lit("]"))
        names = F.transform(
            F.split(F.regexp_extract(found, regex, 2), ","),
            lambda k: F.regexp_replace(k, f"(?U)^{WS}+|{WS}+$", ""),
        )
        shift = F.length(F.regexp_extract(found, regex, 1)) > 0
        return F.struct(
            F.when(shift, line + 1).otherwise(line).cast("int").alias("line"),
            (~bracketed).alias("all_kinds"),
            F.when(bracketed, F.filter(names, lambda k: k != "")).otherwise(
                F.array().cast("array<string>")
            ).alias("kinds"),
        )

    per_line = F.transform(
        F.split(text, "\n", -1),
        lambda line, i: F.struct(
            (i + 1).alias("line"),
            F.when(
                F.contains(line, F.lit(prefix)),
                F.regexp_extract_all(line, F.lit(regex), F.lit(0)),
            ).alias("found"),
        ),
    )
    marked = F.filter(per_line, lambda x: F.size(x["found"]) > 0)
    markers = F.flatten(
        F.transform(marked, lambda x: F.transform(x["found"], lambda m: one(m, x["line"])))
    )
    return F.when(F.contains(text, F.lit(prefix)), markers).otherwise(
        F.array().cast(f"array<{MARKER}>")
    )
