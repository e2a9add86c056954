"""Which findings could be moved to the environment, and the line that would do it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hushscan.functions.folds import bind
from hushscan.functions.paths import suffix
from hushscan.operators.cluster import materialise, never_broadcast
from hushscan.operators.detect import DEFAULT, scan_texts
from hushscan.operators.ordered import numbered
from hushscan.options import Options

# --- Fixed values: languages a plan is offered for, and display names -------------
PYTHON = (".py",)
JAVASCRIPT = (".js", ".jsx")
TYPESCRIPT = (".ts", ".tsx")
LANGUAGES = {
    ".js": "JavaScript", ".jsx": "JavaScript (JSX)", ".ts": "TypeScript", ".tsx": "TypeScript (TSX)",
    ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS", ".vue": "Vue", ".svelte": "Svelte",
    ".json": "JSON", ".jsonc": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".ini": "INI",
    ".cfg": "CFG", ".conf": "CONF", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell",
    ".ps1": "PowerShell", ".bat": "Batch", ".cmd": "Batch", ".xml": "XML", ".md": "Markdown",
    ".txt": "text", ".sql": "SQL", ".graphql": "GraphQL", ".gql": "GraphQL",
}
_PYTHON_KEYWORDS = (
    "False|None|True|and|as|assert|async|await|break|class|continue|def|del|elif|else|except|finally|"
    "for|from|global|if|import|in|is|lambda|nonlocal|not|or|pass|raise|return|try|while|with|yield|__debug__"
)

# A deliberately narrow reading of "NAME = one plain string": no escapes, no prefix.
_PY = (
    rf"(?U)^([ \t]*)(?!(?:{_PYTHON_KEYWORDS})\b)([^\W\d]\w*)[ \t]*=[ \t]*"
    r"(?:\"([^\"\\]*+)\"(?!\")|'([^'\\]*+)'(?!'))[ \t]*(?:;[ \t]*)?(?:#.*)?$"
)
# A script declaration is read as two halves around its first equals sign:
# what is declared, and one literal that ends the line.
_DECLARED = (
    r"(?U)^(\s*(?:export\s+)?(?:const|let|var))\s+([A-Za-z_$][A-Za-z0-9_$]*)"
    r"(\s*:\s*[A-Za-z_$][A-Za-z0-9_$<>\[\].,|&\s]*?)?\s*$"
)
_LITERAL = r"(?sU)^\s*([\"'`])((?:(?!\1)[^\\]|\\.)*+)\1\s*(;?)\s*(?://[^\n]*)?$"
_WORD = "[A-Z]+(?![a-z])[a-z0-9]*|[A-Z]?[a-z0-9]+"


def suggest_env_name(name: Column) -> Column:
    """Environment variable name for an identifier: ``myAPIKey`` -> ``MY_API_KEY``."""
    words = F.regexp_extract_all(name, F.lit(_WORD), F.lit(0))
    return F.when(F.size(words) == 0, F.lit("SECRET_KEY")).otherwise(F.upper(F.array_join(words, "_")))


def language(path: Column) -> Column:
    """Display name of a file's language."""
    extension = F.lower(suffix(path))
    name = F.when(
        F.startswith(F.substring_index(path, "/", -1), F.lit(".env")), F.lit("env files")
    )
    for ext, label in LANGUAGES.items():
        name = name.when(extension == ext, F.lit(label))
    plain = F.regexp_replace(extension, r"^\.", "")
    return name.otherwise(F.when(plain != "", plain).otherwise(F.lit("this file type")))


def assignment(line: Column, path: Column, value: Column) -> Column:
    """Struct (variable, head, tail) when the line is exactly one plain assignment of ``value``.

    The proposed line is ``head`` + key + ``tail``; NULL means leave it alone.
    """
    code = F.rtrim(line, F.lit("\r\n"))
    extension = F.lower(suffix(path))
    py = lambda i: F.regexp_extract(code, _PY, i)
    left = F.substring_index(code, "=", 1)
    right = code.substr(F.length(left) + 2, F.length(code))
    declared = lambda i: F.regexp_extract(left, _DECLARED, i)
    literal = lambda i: F.regexp_extract(right, _LITERAL, i)
    quote = F.when(F.regexp_replace(code, r"^[^=]*=\s*", "").startswith("'"), F.lit("'")).otherwise(F.lit('"'))
    python = bind(
        F.concat(py(3), py(4)),
        lambda v: F.when(
            code.rlike(_PY) & (v == value),
            F.struct(
                py(2).alias("variable"),
                F.concat(py(1), py(2), F.lit(" = os.getenv("), quote).alias("head"),
                F.concat(quote, F.lit(")")).alias("tail"),
            ),
        ),
    )
    template = (literal(1) == "`") & F.contains(literal(2), F.lit("${"))
    script = F.when(
        left.rlike(_DECLARED) & right.rlike(_LITERAL) & (literal(2) == value) & ~template,
        F.struct(
            declared(2).alias("variable"),
            F.concat(declared(1), F.lit(" "), declared(2), declared(3), F.lit(' = process.env["')).alias("head"),
            F.concat(
                F.lit('"]'), F.when(extension.isin(*TYPESCRIPT), F.lit("!")).otherwise(F.lit("")), literal(3)
            ).alias("tail"),
        ),
    )
    return F.when(extension.isin(*PYTHON), python).when(
        extension.isin(*JAVASCRIPT, *TYPESCRIPT), script
    )


def candidates(texts: DataFrame, path: str = "path", text: str = "text", options: Options = DEFAULT) -> DataFrame:
    """Findings with their source line judged: (file, line, start, kind, fixable, desired, head, tail)."""
    keep = [c for c in ("project",) if c in texts.columns]
    scanned = scan_texts(texts, path, text, options, [*keep, text])
    # lines are split once per text, and only where something was found
    with_lines = F.when(
        F.size("spans") > 0,
        bind(
            F.split(F.col(text), "\n", -1),
            lambda lines: F.transform(
                "spans", lambda s: F.struct(s.alias("s"), F.get(lines, s["line"] - 1).alias("source"))
            ),
        ),
    )
    rows = scanned.select("source_id", *keep, F.explode_outer(with_lines).alias("f")).where("f is not null")
    judged = rows.select(
        F.col("source_id").alias("file"),
        *(F.col(c) for c in keep),
        F.col("f.s.line").alias("line"),
        F.col("f.s.start").alias("start"),
        F.col("f.s.kind").alias("kind"),
        assignment(F.col("f.source"), F.col("source_id"), F.col("f.s.value")).alias("a"),
    )
    return judged.select(
        "file", *keep, "line", "start", "kind",
        language(F.col("file")).alias("language"),
        F.col("a").isNotNull().alias("fixable"),
        F.when(F.col("a").isNotNull(), suggest_env_name(F.col("a.variable"))).alias("desired"),
        F.col("a.head").alias("head"),
        F.col("a.tail").alias("tail"),
    )


#: a name that another name's claims can end up with: that name and a number
_NUMBERED = "^(.+)_([2-9]|[1-9][0-9]{1,8})$"


def assign_env_keys(rows: DataFrame, existing: DataFrame, order: tuple[str, ...] = ("file", "start")) -> DataFrame:
    """Give each row a key no other row and no existing entry of its project has.

    ``order`` names a row within its project, so it must be unique there.  Rows
    claim in that order: the desired name, else the first free ``_2``,
    ``_3``, ...  ``rows`` need ``project`` and ``desired``; ``existing`` is
    ``(project, key)``.

    The claims of one name take the numbers 1 (the name itself), 2, 3, ... but
    for those taken before.  A number n is taken by an existing entry, or by
    the first claim of the name ``name_n`` if that comes before the claims of
    ``name`` have got to n.  Which of them do is settled on the distinct names
    alone; then every claim is numbered at once.  No task holds the claims or
    the keys of a name.
    """
    return _numbered_claims(rows, materialise(_taken(rows, existing, order)), order)


def _parts(name: str) -> tuple[Column, Column]:
    """The name in front of a number, null if there is none, and the number."""
    base = F.nullif(F.regexp_extract(name, _NUMBERED, 1), F.lit(""))
    return base, F.regexp_extract(name, _NUMBERED, 2).try_cast("bigint")


def _taken(rows: DataFrame, existing: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(project, desired, number): the numbers each name's claims find taken."""
    name = ["project", "desired"]
    claims = rows.select(*name, *order)
    base, number = _parts("desired")
    names = materialise(
        claims.groupBy(*name).agg(F.min(F.struct(*order)).alias("first")).withColumns({"base": base, "at": number})
    )
    wanted = names.select(*name)
    # entries of the project that are a desired name or number one
    entry, entry_number = _parts("key")
    entries = existing.select("project", "key").distinct()
    held = entries.select("project", F.col("key").alias("desired"), F.lit(1).cast("bigint").alias("n")).unionByName(
        entries.select("project", entry.alias("desired"), entry_number.alias("n")).where("desired IS NOT NULL")
    ).join(wanted, name, "left_semi")
    # first claims of names that number another desired name, and how many claims that one had before
    numbering = names.where("base IS NOT NULL").select(
        "project", F.col("base").alias("desired"), F.col("at").alias("n"), "first.*"
    ).join(wanted, name, "left_semi")
    both = claims.join(numbering.select(*name).distinct(), name, "left_semi").withColumn("n", F.lit(None).cast("bigint"))
    placed = numbered(both.unionByName(numbering), name, order).where("n IS NOT NULL")
    ranked = numbered(placed.withColumnRenamed("nth", "place"), name, order)
    rivals = ranked.select(*name, "n", (F.col("place") - F.col("nth")).cast("bigint").alias("before"))
    numbers = held.withColumn("before", F.lit(0).cast("bigint")).unionByName(rivals)
    numbers = materialise(numbers.groupBy(*name, "n").agg(F.min("before").alias("before")))
    own = numbers.where("n = 1").select(*name, F.lit(True).alias("known"))
    events = numbers.where("n > 1").select(*name, "n", (F.col("n") - F.col("before")).alias("reach"))
    state = materialise(names.select(*name, "base", "at").join(own, name, "left"))
    # a name's own number 1 may be taken by the claims of its base, so bases are settled first
    upper = state.select("project", F.col("desired").alias("base"), F.lit(True).alias("_upper"))
    level = state.join(upper, ["project", "base"], "left").withColumn("lost", F.coalesce("known", F.lit(False)))
    level, left = level.where("_upper IS NULL"), materialise(level.where("_upper"))
    out = None
    while True:
        level = materialise(level.select(*name, "lost"))
        settled = materialise(_effective(events.join(level, name)))
        part = level.where("lost").select(*name, F.lit(1).cast("bigint").alias("number")).unionByName(settled)
        out = part if out is None else out.unionByName(part)
        below = left.join(level.select("project", F.col("desired").alias("base")), ["project", "base"])
        if below.limit(1).count() == 0:
            return out
        # its first claim gets the name itself where that number was left to it; the
        # numbers are looked up as rows, since each of very many names asks for one
        kept = settled.select("project", F.col("desired").alias("base"), F.col("number").alias("at"), F.lit(True).alias("_kept"))
        level = below.join(never_broadcast(kept), ["project", "base", "at"], "left").withColumn(
            "lost", F.col("lost") | (F.col("at").isNotNull() & F.col("_kept").isNull())
        )


def _effective(events: DataFrame) -> DataFrame:
    """(project, desired, number): the numbers that are taken before the claims get to them.

    Of the numbers up to n, as many as are taken are skipped, so claim
    n - skipped would get n; ``reach`` is n less the claims made before.  The
    numbers of a name are rows that pass one task in order, which holds none.
    """
    name = ["project", "desired"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, skipped = None, 0
        for batch in batches:
            taken = []
            for project, desired, reach, lost in zip(*(batch.column(c).to_pylist() for c in (*name, "reach", "lost"))):
                if of != (project, desired):
                    of, skipped = (project, desired), int(lost)
                taken.append(skipped < reach)
                skipped += taken[-1]
            yield batch.select([*name, "n"]).filter(pa.array(taken, pa.bool_())).rename_columns([*name, "number"])

    fields = [f"{c} {events.schema[c].dataType.simpleString()}" for c in name]
    return events.repartition(*name).sortWithinPartitions(*name, "n").mapInArrow(fold, ", ".join([*fields, "number bigint"]))


def _numbered_claims(rows: DataFrame, taken: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """n-th claim of a name = n-th number that is not taken."""
    name = ("project", "desired")
    ranked = numbered(rows, name, order)
    # The k-th taken number u pushes every claim from the (u - k + 1)-th on by one.
    # Claims and such pushes are put in one order, and a claim's number is its place in it.
    nth_taken = numbered(taken, name, ("number",))
    pushes = nth_taken.select(*name, (F.col("number") - F.col("nth") + 1).cast("long").alias("_at"), F.lit(0).alias("_claim"))
    claims = ranked.select(*rows.columns, F.col("nth").cast("long").alias("_at"), F.lit(1).alias("_claim"))
    placed = numbered(claims.unionByName(pushes, allowMissingColumns=True), name, ("_at", "_claim")).where("_claim = 1")
    key = F.when(F.col("nth") == 1, F.col("desired")).otherwise(F.concat_ws("_", "desired", "nth"))
    return placed.select(*rows.columns, key.alias("env_key"))


def fix_plan(
    texts: DataFrame,
    existing: DataFrame | None = None,
    path: str = "path",
    text: str = "text",
    options: Options = DEFAULT,
) -> DataFrame:
    """Every finding with ``fixable`` and, where so, its env key and proposed line.

    A source line is rewritten once, for its first fixable finding; after that
    it no longer holds the literal, so its other findings are not fixable.
    """
    found = candidates(texts, path, text, options)
    if "project" not in found.columns:
        found = found.withColumn("project", F.lit(""))
    line = Window.partitionBy("project", "file", "line", "fixable").orderBy("start", "kind")
    found = found.withColumn("fixable", F.col("fixable") & (F.row_number().over(line) == 1))
    found = materialise(found)  # read several times below; holds no values
    if existing is None:
        existing = found.sparkSession.createDataFrame([], "project string, key string")
    claimed = assign_env_keys(found.where("fixable"), existing, ("file", "line"))
    fixable = claimed.select(
        "project", "file", "line", "start", "kind", "language", "fixable", "env_key",
        F.concat("head", "env_key", "tail").alias("proposed_line"),
    )
    rest = found.where(~F.col("fixable")).select(
        "project", "file", "line", "start", "kind", "language", "fixable",
        F.lit(None).cast("string").alias("env_key"),
        F.lit(None).cast("string").alias("proposed_line"),
    )
    return fixable.unionByName(rest)


def env_keys(lines: DataFrame, column: str = "line") -> DataFrame:
    """(project, key) of environment-file lines ``(project, line)``."""
    stripped = F.trim(F.col(column), F.lit(" \t\r\n\f\x0b"))
    return (
        lines.select("project", stripped.alias("_l"))
        .where(~F.startswith("_l", F.lit("#")) & F.contains("_l", F.lit("=")))
        .select("project", F.trim(F.substring_index("_l", "=", 1), F.lit(" \t")).alias("key"))
    )
