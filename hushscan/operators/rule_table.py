"""Detection rules kept in a table, any number of them.

A plan with a branch for each rule ends at a few hundred.  Here rules stay
rows.  From each pattern the longest literal that every match must contain is
taken out; all literals together form one index (``operators.search``), which
finds the rules a text can match at all, and only those are tried.  Rules
without such a literal are tried on every text.  The plan is the same for one
rule and for a million.

Patterns are Python regular expressions and are matched as such, in the tasks
that hold the candidates; every task keeps a bounded number of compiled ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from re import _compiler, _constants as C, _parser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hushscan.functions import spans as S
from hushscan.operators.cluster import materialise, never_broadcast
from hushscan.operators.detect import DEFAULT, explode_findings, scan_texts
from hushscan.operators.ordered import numbered
from hushscan.operators.search import digest, text_hits
from hushscan.options import Options

#: the place of a custom rule among the rules of a text
_FIRST = S.CUSTOM_ORDER
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("neg", pa.int32()), ("rule", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
_TRIED = "array<struct<rule:int,name:string,pattern:string>>"


def required_literal(pattern: str) -> str | None:
    """The longest literal that stands in every match, None if there is none to be sure of.

    Only what cannot be skipped counts: not the branches of an alternative,
    nothing that may repeat no times, nothing that ignores case.
    """
    return _literal_of(_parser.parse(pattern))


def _literal_of(tree: _parser.SubPattern) -> str | None:
    found = [""]

    def walk(items, folded: bool) -> None:
        run = ""
        for op, given in items:
            if op is C.LITERAL and not folded:
                run += chr(given)
                continue
            if op is C.AT:
                continue  # anchors take no characters
            found.append(run)
            run = ""
            if op is C.SUBPATTERN:
                _, on, off, inner = given
                walk(inner, (folded or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and given[0] > 0:
                walk(given[2], folded)
            elif op is C.ATOMIC_GROUP:
                walk(given, folded)
        found.append(run)

    walk(tree, bool(tree.state.flags & re.IGNORECASE))
    return max(found, key=len) or None


@lru_cache(maxsize=20_000)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _read(pattern: str | None, name: str | None) -> tuple[str | None, str | None]:
    """(message, literal) of one row."""
    if not name:
        return 'missing or invalid "name"', None
    if not pattern:
        return 'missing or invalid "pattern"', None
    try:
        tree = _parser.parse(pattern)  # once, which is most of the work
        _compiler.compile(tree)
        return None, _literal_of(tree)
    except (re.error, RecursionError, OverflowError):
        return "invalid regular expression", None


def read_rules(rules: DataFrame) -> DataFrame:
    """Rows ``(name, pattern)`` -> (rule_index, name, pattern, message, literal), in order of name and pattern.

    ``message`` tells why a row is no rule; such a row never disables the rest.
    Rows that repeat are rules of their own.  Other columns are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_read(p, n) for n, p in zip(batch.column("name").to_pylist(), batch.column("pattern").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([t[i] for t in told], pa.string()) for i in (0, 1))],
                names=["rule_index", "name", "pattern", "message", "literal"],
            )

    rows = rules.select(F.col("name").cast("string"), F.col("pattern").cast("string"))
    placed = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], ["name", "pattern"])
    index = (F.col("nth") - 1).cast("int").alias("rule_index")
    # reading a pattern takes far longer than moving it, so they are dealt out to all tasks
    dealt = placed.select(index, "name", "pattern").repartition(_tasks(rules), "rule_index")
    return dealt.mapInArrow(read, "rule_index int, name string, pattern string, message string, literal string")


def _tasks(rows: DataFrame) -> int:
    """A number of partitions that adaptive execution does not lower."""
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _matches(text: str, rules: Sequence[dict]) -> list[dict]:
    found = []
    for rule in rules:
        for match in _compiled(rule["pattern"]).finditer(text):
            if match.end() > match.start():
                found.append({"start": match.start(), "neg": match.start() - match.end(), "rule": _FIRST + rule["rule"], "kind": rule["name"], "value": match.group()})
    return found


def _tried(rows: DataFrame, text: str, rules: str, by: str, name: str) -> DataFrame:
    """All columns but ``rules`` and ``by``, and the matches of each row's own rules in its text.

    Neighbours with the same ``by`` are tried once.
    """
    kept = [i for i, c in enumerate(rows.columns) if c not in (rules, by)]
    flat = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    at, mine, key = (rows.columns.index(c) for c in (text, rules, by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, spans = None, []
        for batch in batches:
            found = []
            for t, r, d in zip(batch.column(at), batch.column(mine), batch.column(key).to_pylist()):
                if d is None or d != of:
                    of, spans = d, _matches(t.as_py(), r.as_py()) if r.is_valid else []
                found.append(spans)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(found, _SPANS)], names=[*(f"c{i}" for i in kept), "found"]
            )

    fields = [f"c{i} {flat.schema[i].dataType.simpleString()}" for i in kept]
    return flat.mapInArrow(run, ", ".join([*fields, f"found array<{S.SPAN}>"])).toDF(*[rows.columns[i] for i in kept], name)


def with_rule_spans(texts: DataFrame, rules: DataFrame, text: str = "text", name: str = "_custom") -> DataFrame:
    """All rows of ``texts`` with the spans of all rules, by the order of ``read_rules``.

    ``rules`` is what ``read_rules`` gave.  Copies of a text are tried once.
    Literals and texts meet as digests (``search.text_hits``); then a rule that a
    text may match moves to the digest of the text, and each text to it, once.
    Null texts have no spans.
    """
    good = materialise(rules.where("message IS NULL"))
    entry = F.struct(F.col("rule_index").alias("rule"), "name", "pattern")
    indexed = good.where("literal IS NOT NULL").select(F.col("literal").alias("needle"), entry.alias("rule"))
    told = texts.withColumn("_digest", digest(F.col(text)))
    hits = text_hits(told.select("_digest", text), indexed, ["_digest"], text)
    chosen = hits.groupBy("_digest").agg(F.array_sort(F.collect_set("rule")).cast(_TRIED).alias("_rules"))
    met = told.join(never_broadcast(chosen), "_digest", "left").select(*texts.columns, "_digest", "_rules")
    return _with_unindexed(_tried(met, text, "_rules", "_digest", name), good, text, name)


def _with_unindexed(rows: DataFrame, good: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the matches of the rules without a literal, which every text has to be tried on."""
    plain = good.where("literal IS NULL").select(F.col("rule_index").alias("rule"), "name", "pattern")
    known = [r.asDict() for r in plain.orderBy("rule").toLocalIterator()]  # each costs a pass over every text
    if not known:
        return rows
    at = rows.columns.index(text)
    flat = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_matches(t.as_py(), shared.value) if t.is_valid else [] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _SPANS)], names=[*batch.schema.names, "more"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in flat.schema]
    out = flat.mapInArrow(run, ", ".join([*fields, f"more array<{S.SPAN}>"])).toDF(*rows.columns, "_more")
    return out.withColumn(name, F.concat(name, "_more")).drop("_more")


def detect_with_rules(
    texts: DataFrame,
    rules: DataFrame,
    source_id: str = "source_id",
    text: str = "text",
    options: Options = DEFAULT,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``operators.detect.detect`` with the rules of a table ``(name, pattern)`` beside the built-in ones."""
    columns = dict.fromkeys([source_id, text, *keep])
    ready = with_rule_spans(texts.select(*columns), read_rules(rules), text)
    return explode_findings(scan_texts(ready, source_id, text, options, keep, extra="_custom"), keep)
