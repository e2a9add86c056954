"""Credential spans as Catalyst expressions: one projection, no shuffle.

All rules are evaluated into one array per text, so a text is read once and no
row is duplicated before its overlaps are resolved.  Offsets are rebuilt from
``split`` gaps and match lengths, in code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from hushscan.functions import patterns as P
from hushscan.functions.folds import bind, chunked, cut, empty_array, running

# `neg` is minus the width: sorting the struct gives (start, widest, rule order).
SPAN = "struct<start:int,neg:int,rule:int,kind:string,value:string>"
LOCATED = (
    "struct<start:int,end:int,kind:string,value:string,line:int,column:int,"
    "end_line:int,end_column:int,custom:boolean>"
)
CUSTOM_ORDER = 1000


def _any_of(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def _view(text: Column) -> Column:
    """What the anchors of the rules are looked up in, computed once per text."""
    runs = F.regexp_extract_all(text, F.lit(P.LONG_RUN), F.lit(0))
    return F.struct(
        text.alias("text"),
        F.lower(text).alias("lowered"),
        _any_of(text, P.FOLDING_LETTERS).alias("folding"),
        F.array_join(runs, " ").alias("runs"),
    )


def _may_match(rule: P.Rule, view: Column) -> Column:
    source = view["lowered" if rule.folded else "runs" if rule.in_run else "text"]
    present = F.lit(True)
    for group in rule.anchors:
        present = present & _any_of(source, group)
    return (present | view["folding"]) if rule.folded else present


# --- value predicates ---------------------------------------------------------


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty string."""
    size = F.length(value)
    share = lambda c: (size - F.length(F.replace(value, c, F.lit("")))) / size
    return F.when(size == 0, F.lit(0.0)).otherwise(
        F.aggregate(
            F.array_distinct(F.split(value, F.lit(""))),
            F.lit(0.0),
            lambda total, c: total - share(c) * F.log2(share(c)),
        )
    )


def is_filler(value: Column) -> Column:
    """Longest alphanumeric run (the first on ties) has at most three characters."""
    runs = F.regexp_extract_all(value, F.lit("[A-Za-z0-9]+"), F.lit(0))
    longest = F.aggregate(
        runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best)
    )
    return bind(
        longest,
        lambda run: (F.length(run) > 0)
        & (F.size(F.array_distinct(F.split(run, F.lit("")))) <= 3),
    )


def is_entropy_candidate(value: Column) -> Column:
    return (
        ~_any_of(F.lower(value), P.ENTROPY_IGNORED_WORDS)
        & (F.size(F.array_distinct(F.split(value, F.lit("")))) > 2)
        & ~value.rlike("^[0-9]+$")
    )


def is_placeholder(value: Column) -> Column:
    edge = "(?U)^" + P.WS + "+|" + P.WS + "+$"
    cleaned = F.lower(
        F.regexp_replace(F.regexp_replace(value, edge, ""), "^['\"]+|['\"]+$", "")
    )
    return bind(
        cleaned,
        lambda v: v.isin(*P.PLACEHOLDER_VALUES)
        | (F.startswith(v, F.lit("your")) & _any_of(v, P.PLACEHOLDER_HINTS))
        | v.rlike("^x+$"),
    )


# --- URL masking ---------------------------------------------------------------


def _blank(length: Column) -> Column:
    return F.repeat(F.lit(" "), length)


def _mask_one(url: Column) -> Column:
    head = F.regexp_extract(url, "^[^?#]*", 0)

    def with_head(h: Column) -> Column:
        tail = url.substr(F.length(h) + 1, F.length(url))
        scheme = F.locate("://", h)
        rest = F.when(scheme > 0, h.substr(scheme + 3, F.length(h))).otherwise(F.lit(""))
        login = F.regexp_extract(F.regexp_extract(rest, "^[^/]*", 0), "(?s)^.*@", 0)
        return bind(
            login,
            lambda kept: F.when(
                F.length(kept) > 0,
                F.concat(
                    _blank(scheme + 2),
                    kept,
                    _blank(F.length(h) - scheme - 2 - F.length(kept)),
                    tail,
                ),
            ).otherwise(F.concat(_blank(F.length(h)), tail)),
        )

    return bind(head, with_head)


def mask_urls(text: Column) -> Column:
    """Same-length copy with scheme, host and path of every URL blanked.

    Credentials before ``@``, query and fragment stay, so entropy still sees them.
    """
    has_url = F.contains(text, F.lit("://")) | text.rlike(r"[wW]{3}\.")
    pieces = F.struct(
        F.split(text, P.URL, -1).alias("gaps"),
        F.transform(
            F.regexp_extract_all(text, F.lit(P.URL), F.lit(0)), _mask_one
        ).alias("urls"),
    )
    rebuilt = bind(
        pieces,
        lambda p: F.array_join(
            F.transform(
                p["gaps"],
                lambda gap, i: F.concat(gap, F.coalesce(F.get(p["urls"], i), F.lit(""))),
            ),
            "",
        ),
    )
    return F.when(has_url, rebuilt).otherwise(text)


# --- matching ------------------------------------------------------------------


def _hit(order: int, kind: str, source: Column, matches: Column) -> Column:
    return F.struct(
        F.lit(order).alias("rule"),
        F.lit(kind).alias("kind"),
        source.alias("source"),
        matches.alias("matches"),
    )


def _spans_of_hit(hit: Column, regexes: dict[int, str]) -> Column:
    """Offsets of one rule's matches: gap lengths from ``split`` plus match lengths."""
    gaps = None
    for order, regex in regexes.items():
        here = F.split(hit["source"], regex, -1)
        gaps = F.when(hit["rule"] == order, here) if gaps is None else gaps.when(hit["rule"] == order, here)

    def place(raw_gaps: Column) -> Column:
        # Java drops the empty piece before a zero-width match at offset 0.
        lead = F.size(hit["matches"]) + 1 - F.size(raw_gaps)
        items = F.transform(
            hit["matches"],
            lambda value, i: F.struct(
                F.coalesce(F.length(F.get(raw_gaps, i - lead)), F.lit(0)).alias("gap"),
                F.length(value).alias("width"),
                value.alias("value"),
            ),
        )

        def emit(at: Column, item: Column) -> Column:
            labelled = hit["rule"] == P.RULE_BY_KIND["generic_labeled_secret"].order
            label = F.when(
                labelled, F.length(F.regexp_extract(item["value"], "(?idU)" + P.LABEL, 0))
            ).otherwise(F.lit(0))
            value = F.when(
                labelled,
                bind(
                    label,
                    lambda skip: F.regexp_extract(
                        item["value"].substr(skip + 1, item["width"]), "(?idU)^" + P.LABELLED_VALUE, 0
                    ),
                ),
            ).otherwise(item["value"])
            return F.array(
                bind(
                    value,
                    lambda v: F.struct(
                        (at + item["gap"] + label).cast("int").alias("start"),
                        (-F.length(v)).alias("neg"),
                        hit["rule"].alias("rule"),
                        hit["kind"].alias("kind"),
                        v.alias("value"),
                    ),
                )
            )

        return running(
            items,
            F.lit(0),
            lambda at, item: at + item["gap"] + item["width"],
            emit,
            SPAN,
        )

    return bind(gaps, place)


def _resolve(hits: Column, regexes: dict[int, str]) -> Column:
    found = F.filter(hits, lambda h: F.size(h["matches"]) > 0)
    return F.flatten(F.transform(found, lambda h: _spans_of_hit(h, regexes)))


def builtin_spans(text: Column, threshold: float = P.DEFAULT_ENTROPY_THRESHOLD) -> Column:
    """All raw spans of the fixed formats and of the entropy scan, before merging."""

    def matched(v: Column) -> Column:
        hits = []
        for rule in P.BUILTIN_RULES:
            matches = F.when(
                _may_match(rule, v), F.regexp_extract_all(v["text"], F.lit(rule.java), F.lit(0))
            )
            hits.append(_hit(rule.order, rule.kind, v["text"], matches))
        # masking only blanks characters, so a candidate is a run of the text as well
        has_candidate = v["runs"].rlike(f"[^ ]{{{P.ENTROPY_RUN}}}")
        hits.append(
            bind(
                F.when(has_candidate, mask_urls(v["text"])),
                lambda masked: _hit(
                    P.ENTROPY_ORDER,
                    P.ENTROPY_KIND,
                    masked,
                    F.regexp_extract_all(masked, F.lit(P.ENTROPY_CANDIDATE), F.lit(0)),
                ),
            )
        )
        return _resolve(F.array(*hits), regexes)

    regexes = {rule.order: rule.java for rule in P.BUILTIN_RULES}
    regexes[P.ENTROPY_ORDER] = P.ENTROPY_CANDIDATE
    filler_rules = [rule.order for rule in P.BUILTIN_RULES if rule.reject_filler]
    return F.filter(
        bind(_view(text), matched),
        lambda s: F.when(s["rule"].isin(*filler_rules), ~is_filler(s["value"]))
        .when(
            s["rule"] == P.ENTROPY_ORDER,
            is_entropy_candidate(s["value"])
            & (F.round(entropy(s["value"]), 9) >= F.lit(float(threshold))),
        )
        .otherwise(F.lit(True)),
    )


def custom_spans(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Whole-match spans of user rules; empty matches are dropped, nothing is merged."""
    if not rules:
        return empty_array(SPAN)
    hits = [
        _hit(CUSTOM_ORDER + i, name, text, F.regexp_extract_all(text, F.lit(regex), F.lit(0)))
        for i, (name, regex) in enumerate(rules)
    ]
    regexes = {CUSTOM_ORDER + i: regex for i, (_, regex) in enumerate(rules)}
    return F.filter(_resolve(F.array(*hits), regexes), lambda s: s["neg"] < 0)


def merge_spans(spans: Column) -> Column:
    """Left-to-right sweep keeping the strictly wider of two overlapping spans."""
    nothing = F.lit(None).cast(SPAN)
    end = lambda s: s["start"] - s["neg"]

    def step(last: Column, cur: Column) -> Column:
        overlaps = last.isNotNull() & (cur["start"] < end(last))
        return F.when(overlaps & (cur["neg"] >= last["neg"]), last).otherwise(cur)

    def emit(last: Column, cur: Column) -> Column:
        closed = last.isNotNull() & (cur["start"] >= end(last))
        return F.when(closed, F.array(last)).otherwise(empty_array(SPAN))

    def tail(last: Column) -> Column:
        return F.when(last.isNotNull(), F.array(last)).otherwise(empty_array(SPAN))

    return running(F.sort_array(spans), nothing, step, emit, SPAN, tail)


def detect_spans(text: Column, threshold: float = P.DEFAULT_ENTROPY_THRESHOLD) -> Column:
    """Merged built-in spans of a text: the reportable unit before any filtering."""
    return bind(
        builtin_spans(text, threshold),
        lambda raw: F.when(F.size(raw) > 0, merge_spans(raw)).otherwise(empty_array(SPAN)),
    )


# --- locations ------------------------------------------------------------------


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _advance(at: Column, passed: Column) -> Column:
    """Move a (line, UTF-16 units since line start) position over ``passed`` text."""
    return bind(
        passed,
        lambda t: bind(
            newline_count(t),
            lambda n: F.struct(
                (at["line"] + n).cast("int").alias("line"),
                (
                    F.when(n > 0, F.lit(0)).otherwise(at["units"])
                    + utf16_length(F.substring_index(t, "\n", -1))
                )
                .cast("int")
                .alias("units"),
            ),
        ),
    )


def locate_spans(text: Column, spans: Column) -> Column:
    """Add 1-based lines and UTF-16 columns (end exclusive) to spans of ``text``.

    One sweep over the spans in order: each stretch of text is looked at once.
    """

    def sweep(v: Column) -> Column:
        def moved(state: Column, s: Column) -> Column:
            return _advance(state["at"], cut(v["chunks"], state["pos"], s["start"]))

        def step(state: Column, s: Column) -> Column:
            return F.struct(s["start"].alias("pos"), moved(state, s).alias("at"))

        def emit(state: Column, s: Column) -> Column:
            def out(begin: Column) -> Column:
                return bind(
                    _advance(begin, s["value"]),
                    lambda finish: F.struct(
                        s["start"].alias("start"),
                        (s["start"] - s["neg"]).alias("end"),
                        s["kind"].alias("kind"),
                        s["value"].alias("value"),
                        begin["line"].alias("line"),
                        (begin["units"] + 1).alias("column"),
                        finish["line"].alias("end_line"),
                        (finish["units"] + 1).alias("end_column"),
                        (s["rule"] >= CUSTOM_ORDER).alias("custom"),
                    ),
                )

            return F.array(bind(moved(state, s), out))

        origin = F.struct(
            F.lit(0).alias("pos"),
            F.struct(F.lit(1).alias("line"), F.lit(0).alias("units")).alias("at"),
        )
        return running(F.sort_array(v["spans"]), origin, step, emit, LOCATED)

    return bind(
        spans,
        lambda s: F.when(
            F.size(s) > 0,
            bind(F.struct(chunked(text).alias("chunks"), s.alias("spans")), sweep),
        ).otherwise(empty_array(LOCATED)),
    )
