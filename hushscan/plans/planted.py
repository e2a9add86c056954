"""Inputs of the registered queries, derived from the given tables.

Ordinary prose holds few credentials, so a fixed line with a credential-shaped
string is added to every text; its body is a digest of the row's id.  The
expressions are plain SQL that Spark and DuckDB both read; only the name of the
SHA-256 function differs (``{sha}``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_UPPER = "aX9pQ2zM7vL0rT4w"
_LOWER = "K8yB1nD6fH3jC5sE"
_HEX = "0123456789abcdef"
_NL, _Q, _DQ, _TAB = "chr(10)", "chr(39)", "chr(34)", "chr(9)"

# Pieces by name; `seed` is the text expression the digests are taken of.
_PARTS = {
    "md5": "md5({seed})",
    "sha": "{sha}({seed}{sha_tail})",
    "up16": "upper(substr(md5({seed}), 1, 16))",
    "digits": "translate(substr(md5({seed}), 1, 6), 'abcdef', '012345')",
    "mixed": (
        f"translate(md5({{seed}}), '{_HEX}', '{_UPPER}') || "
        f"translate(md5(concat({{seed}}, 'b')), '{_HEX}', '{_LOWER}')"
    ),
}


def _line(*parts: str) -> str:
    return " || ".join(parts)


def _head(name: str, size: int, at: int = 1) -> str:
    return f"substr({{{name}}}, {at}, {size})"


# One line per slot: the credential formats, then suppressed, filler and overlap cases.
LINES = (
    _line("'AKIA'", "{up16}"),
    _line("'aws_secret_access_key = '", _Q, f"translate({_head('sha', 40)}, '{_HEX}', '{_UPPER}')", _Q),
    _line("'ghp_'", _head("sha", 36)),
    _line("'sk-proj-'", "{mixed}"),
    _line("'sk-ant-api03-'", "{mixed}"),
    _line("'xox'", "'b-'", _head("sha", 40)),
    _line("'sk_live_'", _head("mixed", 24)),
    _line("'AIza'", _head("mixed", 35)),
    _line("'glpat-'", _head("md5", 20)),
    _line("'npm_'", _head("sha", 36)),
    _line("'pypi-AgE'", "{mixed}"),
    _line("'SG.'", _head("mixed", 22), "'.'", _head("sha", 43)),
    _line("'hf_'", _head("mixed", 34)),
    _line("'https://hooks.slack.com/services/T0123ABCD/B0123ABCD/'", _head("md5", 24)),
    _line("'https://discord.com/api/webhooks/123456789012345678/'", "{mixed}"),
    _line("'eyJ'", _head("mixed", 12), "'.'", _head("mixed", 20, 13), "'.'", _head("sha", 30)),
    _line("'Authorization: Bearer '", _head("sha", 30)),
    _line(
        "'-----BEGIN RSA PRIVATE KEY-----'", _NL, "{sha}", _NL, "{md5}", _NL, "'-----END RSA PRIVATE KEY-----'"
    ),
    _line("'password: '", _DQ, _head("md5", 12), _DQ),
    "{mixed}",
    _line("'AKIA'", "{up16}", "'  # hushscan:ignore'"),
    _line("'# hushscan:ignore-next-line[github_token]'", _NL, "'x = ghp_'", _head("sha", 36)),
    "'token = changeme'",
    _line("'https://host.io/'", "{mixed}"),
    _line("'https://u:'", "{mixed}", "'@host.io/x'"),
    _line("'glpat-'", "repeat('x', 20)"),
    _line("'api_key = '", _Q, "'npm_'", _head("sha", 36), _Q, "' INT-'", "{digits}"),
    _line("'secret=gldt-'", _head("md5", 20), "' # hushscan:ignore[npm_token]'"),
    _line("'my_password'", _TAB, "'='", _NL, "'  '", _DQ, _head("sha", 20)),
    _line("chr(128512)", "' key ghp_'", _head("sha", 36), "' '", "chr(128512)"),
)
SLOTS = len(LINES)


def _fill(template: str, seed: str, engine: str) -> str:
    sha = ("sha2", ", 256") if engine == "spark" else ("sha256", "")
    for name, part in _PARTS.items():
        body = part.replace("{seed}", seed).replace("{sha_tail}", sha[1]).replace("{sha}", sha[0])
        template = template.replace("{" + name + "}", f"({body})")
    if engine == "spark":
        # Spark's chr() stops at 255
        template = template.replace("chr(128512)", "'\U0001f600'")
    return template


def line_expr(engine: str, key: str, seed: str) -> str:
    """CASE expression giving the planted line of slot ``key % SLOTS``."""
    cases = " ".join(f"WHEN {i} THEN {_fill(t, seed, engine)}" for i, t in enumerate(LINES))
    return f"CASE ({key}) % {SLOTS} {cases} END"


def own_seed(key: str, salt: str = "p") -> str:
    """A credential of its own for every row."""
    return f"concat('{salt}', {key})"


def shared_seed(key: str, copies: int = 5) -> str:
    """A few credentials per slot, so that each has many copies."""
    return f"concat('s', ({key}) % {SLOTS}, '-', cast(floor(({key}) / {SLOTS}) as int) % {copies})"


def documents_sql(engine: str, seed: str = own_seed("doc_id")) -> str:
    line = line_expr(engine, "doc_id", seed)
    return f"SELECT doc_id, lang, source, text || chr(10) || {line} || chr(10) AS text FROM documents"


PATH_EXPR = (
    "concat('app', doc_id % 3, '/', source, '/file', doc_id, "
    "CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.rb' ELSE '.PY' END)"
)


# --- change history: every conversation turn is a commit, newest turn first ----------


def patch_sql(engine: str) -> str:
    """(repo, line_no, line): a patch stream per repo built from the conversations."""
    sha = "sha2(concat(conv_id, '-', turn), 256)" if engine == "spark" else "sha256(concat(conv_id, '-', turn))"
    path = "concat('dir', conv_id % 3, '/c', conv_id % 5, '.txt')"
    planted = line_expr(engine, "conv_id", "concat('h', conv_id % 30)")
    parts = [
        f"'@@commit ' || {sha}",
        f"'diff --git a/' || {path} || ' b/' || {path}",
        f"'--- a/' || {path}",
        f"CASE WHEN turn % 7 = 6 THEN '+++ /dev/null' ELSE '+++ b/' || {path} END",
        "'@@ -' || (turn + 1) || ' +' || (turn + 3) || ',9 @@ note'",
        "'--- removed'",
        "'+++ b/not-a-header'",
    ]
    split = "split" if engine == "spark" else "string_split"
    plus = "transform" if engine == "spark" else "list_transform"
    lam = "l -> concat('+', l)" if engine == "spark" else "lambda l: concat('+', l)"
    join = "concat" if engine == "spark" else "list_concat"
    make = "array" if engine == "spark" else "list_value"
    second = f"{make}('@@ -' || (turn + 50) || ',0 +' || (turn + 90) || ' @@')"
    body = f"{plus}({split}(text, chr(10)), {lam})"
    extra = f"{plus}({split}({planted}, chr(10)), {lam})"
    lines = f"{join}({join}({make}({', '.join(parts)}), {body}), {join}({second}, {extra}))"
    base = "(conv_id * 100 + (99 - turn)) * 10000"
    if engine == "spark":
        return (
            f"SELECT concat('r', conv_id % 4) AS repo, {base} + pos AS line_no, col AS line "
            f"FROM (SELECT conv_id, turn, posexplode({lines}) FROM conversations)"
        )
    return (
        f"SELECT repo, base + i - 1 AS line_no, lines[i] AS line FROM "
        f"(SELECT concat('r', conv_id % 4) AS repo, {base} AS base, {lines} AS lines FROM conversations), "
        "unnest(range(1, len(lines) + 1)) AS u(i)"
    )


# --- Spark frames ----------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes of a table's files whose rows one task gets at most
PART_BYTES = 8 << 20


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks to deal a table out to, by its bytes, asked of its file system: the same number for every core."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    length = system.getContentSummary(path).getLength()
    cores = spark.sparkContext.defaultParallelism
    return cores * max(1, -(-length // (cores * PART_BYTES)))


def evened(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table for work that is bound by the CPU.

    Spark cannot split a row group, and a file of any size may be a single one,
    so the rows are dealt out before the work: tasks grow in number with the
    table and not in length.
    """
    return table(spark, sf_dir, name).repartition(parts(spark, sf_dir, name), *keys)


def documents(spark: SparkSession, sf_dir: str, seed: str = own_seed("doc_id")) -> DataFrame:
    base = evened(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", "lang", "source")
    line = line_expr("spark", "doc_id", seed)
    return base.select(
        "doc_id", "lang", "source", F.concat("text", F.lit("\n"), F.expr(line), F.lit("\n")).alias("text")
    )


def patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = evened(spark, sf_dir, "conversations", "conv_id")
    inner = patch_sql("spark")
    start, end = inner.index("(SELECT"), inner.index(" FROM conversations)")
    exploded = base.selectExpr(
        *["conv_id", "turn", inner[inner.index("posexplode(", start) : end]]
    )
    return exploded.selectExpr(
        "concat('r', conv_id % 4) AS repo",
        "(conv_id * 100 + (99 - turn)) * 10000 + pos AS line_no",
        "col AS line",
    )
