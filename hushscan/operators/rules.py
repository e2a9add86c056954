"""User-defined detection rules: validation and a try-out report."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from hushscan.functions import spans as S

_ERRORS = "rule_index int, name string, message string"
_RULES = "name string, pattern string"


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[tuple[str, str], ...]
    errors: tuple[tuple[int | None, str | None, str], ...]

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rules), _RULES)

    def errors_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.errors), _ERRORS)


_TOKEN = re.compile(r"\\.|\(\?P<|\(\?P=(\w+)\)|\[|\]|.", re.S)


def to_java(pattern: str) -> str:
    """Named groups in Java spelling, `.` stopping at newline, Unicode classes.

    The pattern is read token by token, so escaped parentheses and those
    inside a character class stay as they are.
    """
    out, in_class, opened = ["(?dU)"], False, False
    for token in _TOKEN.finditer(pattern):
        text = token.group(0)
        if in_class:
            # a bracket right after the opening one, or after its ^, is a plain character
            closes = text == "]" and not opened
            opened = opened and text == "^" and out[-1] == "["
            in_class = not closes
            for char in (text,) if len(text) <= 1 or text[0] == "\\" else text:
                out.append("\\" + char if char in "[&" or char == "]" and not closes else char)
        elif text == "[":
            in_class = opened = True
            out.append(text)
        elif text == "(?P<":
            out.append("(?<")
        elif token.group(1):
            out.append(f"\\k<{token.group(1)}>")
        else:
            out.append(text)
    return "".join(out)


def compile_rules(spark: SparkSession, entries: object) -> RuleSet:
    """Good rules and one error row per bad one; a bad rule never disables the rest."""
    rules: list[tuple[str, str]] = []
    errors: list[tuple[int | None, str | None, str]] = []
    if entries is None:
        return RuleSet((), ())
    if not isinstance(entries, (list, tuple)):
        return RuleSet((), ((None, None, '"rules" must be a list of tables'),))
    compiler = spark._jvm.java.util.regex.Pattern
    for index, entry in enumerate(entries):
        if not isinstance(entry, dict):
            errors.append((index, None, "a rule must be a table"))
            continue
        name, pattern = entry.get("name"), entry.get("pattern")
        if not isinstance(name, str) or not name:
            errors.append((index, None, 'missing or invalid "name"'))
        elif not isinstance(pattern, str) or not pattern:
            errors.append((index, name, 'missing or invalid "pattern"'))
        else:
            java = to_java(pattern)
            try:
                compiler.compile(java)
            except Exception:  # noqa: BLE001 - the gateway wraps PatternSyntaxException
                errors.append((index, name, "invalid regular expression"))
            else:
                rules.append((name, java))
    return RuleSet(tuple(rules), tuple(errors))


def rules_from_table(rules: DataFrame) -> RuleSet:
    """Rules kept in a table ``(name, pattern)``, in name order.

    A rule is configuration that becomes part of the plan, so all of them are
    read onto the driver, however many there are.
    """
    rows = rules.select("name", "pattern").orderBy("name", "pattern").toLocalIterator()
    return compile_rules(rules.sparkSession, [r.asDict() for r in rows])


def test_rules(
    samples: DataFrame,
    rules: Sequence[tuple[str, str]],
    sample_id: str = "sample_id",
    text: str = "text",
) -> DataFrame:
    """First match of every rule in every sample: (rule, sample_id, matched, start, end)."""

    def first(name: str, regex: str):
        spans = S.custom_spans(F.col(text), [(name, regex)])
        span = F.get(spans, F.lit(0))
        return F.struct(F.lit(name).alias("rule"), span.alias("span"))

    tried = samples.select(
        F.col(sample_id).alias("sample_id"),
        F.explode(F.array(*[first(n, r) for n, r in rules])).alias("t"),
    )
    return tried.select(
        F.col("t.rule").alias("rule"),
        "sample_id",
        F.col("t.span").isNotNull().alias("matched"),
        F.col("t.span.start").alias("start"),
        (F.col("t.span.start") - F.col("t.span.neg")).alias("end"),
    )


test_rules.__test__ = False  # not a pytest case


def unique_rule_ids(names: Iterable[str], prefix: str, taken: Iterable[str]) -> dict[str, str]:
    """Stable ids for custom rules: slug of the name, ``-2``, ``-3`` on collision."""
    used = set(taken)
    out: dict[str, str] = {}
    for name in names:
        if name in out:
            continue
        slug = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "rule"
        candidate, n = prefix + slug, 2
        while candidate in used:
            candidate, n = f"{prefix}{slug}-{n}", n + 1
        used.add(candidate)
        out[name] = candidate
    return out
