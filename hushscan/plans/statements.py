"""Equivalent DuckDB statements of the registered queries."""

from __future__ import annotations

from hushscan.functions import catalog as K, patterns as P
from hushscan.functions.paths import SCANNED_EXTENSIONS, SKIPPED_DIRECTORIES
from hushscan.options import Options
from hushscan.plans import oracle as O, planted as PL, registry as R

STATEMENTS: dict[str, str] = {}

_MASK = O.quote(P.DEFAULT_MASK)
_COPIES = PL.shared_seed("doc_id")


def _docs(seed: str = PL.own_seed("doc_id")) -> str:
    return f"SELECT doc_id AS id, lang, source, text FROM ({PL.documents_sql('duckdb', seed)})"


def _with(source: str, *ctes: str) -> str:
    return f"WITH src AS ({source}), " + ",\n".join(c.strip() for c in ctes) + "\n"


def _found(source: str | None = None, **settings) -> str:
    return _with(source or _docs(), O.found_ctes(**settings))


def _paths(seed: str = _COPIES, where: str = "") -> str:
    return (
        f"SELECT {PL.PATH_EXPR} AS id, lang, source, text FROM ({PL.documents_sql('duckdb', seed)}) {where}"
    )


_LOC = '"start", "end", line, "column", end_line, end_column'
_ID = "cast(id AS varchar) AS source_id"

# --- detection -----------------------------------------------------------------------

STATEMENTS["detect_counts_by_kind"] = _found() + "SELECT kind, count(*) AS findings FROM found GROUP BY kind"
STATEMENTS["detected_findings"] = _found() + f"SELECT {_ID}, {_LOC}, kind, finding_id FROM found"
STATEMENTS["known_format_matches"] = (
    _with(_docs(), O.raw_ctes())
    + 'SELECT id AS doc_id, kind, s AS "start", s + length(value) AS "end" FROM raw'
)
STATEMENTS["merged_spans"] = (
    _with(_docs(), O.merged_ctes())
    + """SELECT d.id AS doc_id, coalesce(n, 0) AS n_raw, coalesce(k, 0) AS n_merged, coalesce(p, '') AS places
    FROM src d LEFT JOIN (SELECT id, count(*) AS n FROM raw GROUP BY id) a USING (id)
    LEFT JOIN (SELECT id, count(*) AS k, string_agg(concat(f.s, '-', f.e), ' ' ORDER BY f.s) AS p
               FROM merged GROUP BY id) b USING (id)"""
)
STATEMENTS["labeled_values"] = (
    _found("SELECT doc_id AS id, text FROM documents")
    + f"""SELECT {_ID}, line, "start", "end", finding_id FROM found WHERE kind = 'generic_labeled_secret'"""
)
STATEMENTS["high_entropy"] = (
    _with(_docs(), O.raw_ctes())
    + f"""SELECT id AS doc_id, s AS "start", s + length(value) AS "end", round({O.entropy_expr('value')}, 6) AS entropy
    FROM raw WHERE kind = 'high_entropy'"""
)
STATEMENTS["url_entropy"] = f"SELECT page_id, round({O.entropy_expr('url')}, 6) AS entropy FROM pages"
STATEMENTS["url_masked_text"] = f"""
WITH src AS (SELECT page_id AS id,
    concat(html, ' ', url, ' ', 'https://u:', md5(url), '@h.io/a?q=', page_id) AS text FROM pages),
hidden AS (SELECT id, text, {O.mask_expr('text')} AS masked FROM src)
SELECT id AS page_id, md5(masked) AS digest, length(masked) = length(text) AS same_length FROM hidden"""
STATEMENTS["placeholder_filtered"] = f"""
SELECT doc_id, {O.placeholder_expr('value')} AS is_placeholder
FROM (SELECT doc_id, {R.PLACEHOLDER_EXPR.replace(' int)', ' bigint)')} AS value FROM documents)"""

# --- redaction -------------------------------------------------------------------------

_REDACTED = f"""
    cuts AS (SELECT id, f.s AS s, f.e AS e, lag(f.e, 1, 0) OVER (PARTITION BY id ORDER BY f.s) AS p FROM merged),
    joined AS (SELECT c.id, string_agg(substr(text, p + 1, s - p) || {_MASK}, '' ORDER BY s) AS head, max(e) AS last
               FROM cuts c JOIN src USING (id) GROUP BY c.id),
    redacted AS (SELECT d.id, CASE WHEN j.id IS NULL THEN text ELSE head || substr(text, last + 1) END AS text,
                        j.id IS NOT NULL AS was_redacted FROM src d LEFT JOIN joined j USING (id))"""
_EVENTS = f"SELECT event_id AS id, ts, event_type, props, {R.EVENT_TEXT} AS text FROM events"
STATEMENTS["redacted_documents"] = (
    _with(_docs(), O.merged_ctes(), _REDACTED)
    + "SELECT id AS doc_id, md5(text) AS digest, was_redacted FROM redacted"
)
STATEMENTS["redacted_events"] = (
    _with(_EVENTS, O.merged_ctes(), _REDACTED)
    + "SELECT id AS event_id, text, was_redacted FROM redacted"
)
STATEMENTS["stream_redaction"] = STATEMENTS["redacted_events"]
STATEMENTS["redact_nested_records"] = (
    f"WITH event AS ({_EVENTS}), src AS (SELECT id * 10 + slot AS id, text FROM (\n"
    "  SELECT id, 0 AS slot, concat('password: ', event_type, '-0123456') AS text FROM event\n"
    "  UNION ALL SELECT id, 1, text FROM event UNION ALL SELECT id, 2, props FROM event\n"
    "  UNION ALL SELECT id, 3, event_type FROM event)),\n"
    + O.merged_ctes().strip() + "," + _REDACTED
    + """SELECT a.id // 10 AS event_id, a.text AS msg, concat(b.text, '|', c.text) AS args, b.text AS named_k,
    d.text AS named_n, b.text AS extra_body, a.id // 10 AS extra_n
    FROM redacted a JOIN redacted b ON b.id = a.id + 1 JOIN redacted c ON c.id = a.id + 2
    JOIN redacted d ON d.id = a.id + 3 WHERE a.id % 10 = 0"""
)
STATEMENTS["scrubbed_documents"] = f"""
WITH RECURSIVE names AS (SELECT n_name AS v, row_number() OVER (ORDER BY length(n_name) DESC, n_name) AS i
    FROM (SELECT DISTINCT n_name FROM nation) WHERE length(n_name) >= 6),
step AS (SELECT doc_id, concat(text, ' in ', n_name, ' and ', n_name) AS text, 0::BIGINT AS i
         FROM documents JOIN nation ON doc_id % 25 = n_nationkey
         UNION ALL SELECT doc_id, replace(text, v, {_MASK}), names.i FROM step JOIN names ON names.i = step.i + 1)
SELECT doc_id, md5(text) AS digest FROM step WHERE i = (SELECT max(i) FROM names)"""

# --- suppression -------------------------------------------------------------------------

STATEMENTS["inline_markers"] = (
    _with(_docs(), O.marker_ctes())
    + f"SELECT {_ID}, line, all_kinds, array_to_string(kinds, ',') AS kinds FROM marks"
)
STATEMENTS["inline_suppressed"] = (
    _found() + f"SELECT {_ID}, line, kind, finding_id FROM (SELECT * FROM located EXCEPT ALL SELECT * FROM found)"
)
STATEMENTS["inline_unsuppressed"] = _found() + f"SELECT {_ID}, line, kind, finding_id FROM found"

# --- baseline ------------------------------------------------------------------------------

_SIDES = """,
    tagged AS (SELECT f.*, lang FROM found f JOIN src USING (id)),
    old AS (SELECT finding_id AS id, cast(id AS varchar) AS file, kind, line FROM tagged WHERE lang IN ('en', 'fr')),
    cur AS (SELECT cast(id AS varchar) AS source_id, line, kind, finding_id FROM tagged WHERE lang <> 'fr')
"""
STATEMENTS["baseline_rows"] = _found() + _SIDES + "SELECT * FROM old"
STATEMENTS["baseline_new_findings"] = (
    _found() + _SIDES + "SELECT * FROM cur WHERE finding_id NOT IN (SELECT id FROM old)"
)
STATEMENTS["baseline_round_trip"] = STATEMENTS["baseline_kept"] = STATEMENTS["baseline_new_findings"]
STATEMENTS["baseline_accepted"] = (
    _found() + _SIDES + "SELECT * FROM cur WHERE finding_id IN (SELECT id FROM old)"
)
STATEMENTS["baseline_resolved"] = (
    _found() + _SIDES + "SELECT * FROM old WHERE id NOT IN (SELECT finding_id FROM cur)"
)
_RECLASSIFIED = ", ".join(O.quote(k) for k in P.RECLASSIFIED_KINDS)
STATEMENTS["baseline_former_kinds"] = (
    _found()
    + f""",
    tagged AS (SELECT f.*, lang FROM found f JOIN src USING (id)),
    old AS (SELECT concat(id, ':', CASE lang WHEN 'en' THEN 'high_entropy' ELSE 'generic_labeled_secret' END,
                          ':', value) AS id FROM tagged WHERE lang IN ('en', 'fr'))
    SELECT {_ID}, line, kind, finding_id FROM tagged t
    WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = concat(t.id, ':', t.kind, ':', t.value)
      OR (t.kind IN ({_RECLASSIFIED}) AND old.id IN (concat(t.id, ':high_entropy:', t.value),
                                                    concat(t.id, ':generic_labeled_secret:', t.value))))"""
)

# --- rules -----------------------------------------------------------------------------------

STATEMENTS["custom_rule_findings"] = (
    _found(custom=R.CUSTOM)
    + f"""SELECT {_ID}, kind, "start", "end", line, kind IN ({', '.join(O.quote(n) for n in R.CUSTOM)}) AS custom,
    finding_id FROM found"""
)
_RULE_TABLE = """rules AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS rule_index,
    substr(translate(md5(name), 'abcdef', '012345'), 1, 1) AS digit,
    CASE WHEN name LIKE '%3' THEN 'invalid regular expression' WHEN name LIKE '%7' THEN 'missing or invalid "pattern"'
    END AS message FROM (SELECT DISTINCT source AS name FROM documents))"""
STATEMENTS["table_rule_findings"] = f"""
WITH src AS ({_docs()}), {_RULE_TABLE},
hit AS ({O.custom_hits('src', {'x': 'INT-[0-9]{6}'})})
SELECT {_ID}, name AS kind, s AS "start", s + 10 AS "end" FROM hit JOIN rules ON substr(value, 5, 1) = digit
WHERE message IS NULL"""
STATEMENTS["table_rule_errors"] = f"""
WITH {_RULE_TABLE} SELECT rule_index, name, message, count(*) AS documents
FROM rules JOIN documents ON source = name WHERE message IS NOT NULL GROUP BY ALL"""
_TRIALS = " UNION ALL ".join(
    f"""SELECT {O.quote(name)} AS rule, id AS sample_id, regexp_matches(text, {O.quote(p)}) AS matched,
    CASE WHEN regexp_matches(text, {O.quote(p)}) THEN length(string_split_regex(text, {O.quote(p)})[1]) END AS "start",
    CASE WHEN regexp_matches(text, {O.quote(p)}) THEN length(string_split_regex(text, {O.quote(p)})[1])
      + length(regexp_extract(text, {O.quote(p)})) END AS "end" FROM src"""
    for name, p in R.CUSTOM.items()
)
STATEMENTS["rule_trials"] = f"WITH src AS ({_docs()}) {_TRIALS}"

STATEMENTS["many_rule_findings"] = f"""
WITH named AS (SELECT doc_id, length(text) + 1 AS place, concat('ord-', doc_id + 1, '-', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS value
               FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS source_id, concat('order ', o_orderkey) AS kind, CAST(place AS INT) AS "start",
       CAST(place + length(value) AS INT) AS "end", sha256(concat_ws(':', CAST(doc_id AS VARCHAR), concat('order ', o_orderkey), value)) AS finding_id
FROM named JOIN orders ON o_orderkey = doc_id + 1"""

# --- files -------------------------------------------------------------------------------------


def _glob(path: str, pattern: str) -> str:
    name = f"string_split({path}, '/')[-1]"
    like = pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    return f"({path} LIKE '{like}' ESCAPE '\\' OR {name} LIKE '{like}' ESCAPE '\\')"


def _selected(path: str, include=(), exclude=(), no_ignore: bool = False) -> str:
    name = f"string_split({path}, '/')[-1]"
    ext = f"regexp_extract({name}, '^.+(\\.[^.]+)$', 1)"
    if include:
        keep = "(" + " OR ".join(_glob(path, g) for g in include) + ")"
    else:
        known = ", ".join(O.quote(e) for e in SCANNED_EXTENSIONS)
        keep = f"(lower({ext}) IN ({known}) OR {ext} = '' OR {name} = '.env' OR starts_with({name}, '.env.'))"
    for g in exclude:
        keep += f" AND NOT {_glob(path, g)}"
    if not no_ignore:
        dirs = ", ".join(O.quote(d) for d in SKIPPED_DIRECTORIES)
        meta = ", ".join(O.quote(m) for m in Options().meta_files)
        keep += f" AND NOT list_has_any(string_split({path}, '/'), [{dirs}]) AND {name} NOT IN ({meta})"
    return f"({keep})"


STATEMENTS["file_selection"] = f"""
SELECT doc_id, {_selected('path')} AS by_default, {_selected('path', no_ignore=True)} AS no_ignore,
    {_selected('path', R.INCLUDE)} AS included, {_selected('path', R.INCLUDE, R.EXCLUDE)} AS both,
    {_selected('path', (), R.EXCLUDE)} AS not_excluded
FROM (SELECT doc_id, {R.FILE_EXPR} AS path FROM documents)"""
STATEMENTS["explicit_files"] = f"""
SELECT doc_id, path FROM (SELECT doc_id, lang, {R.FILE_EXPR} AS path FROM documents)
WHERE lang = 'de' OR {_selected('path', (), R.EXCLUDE)}"""
STATEMENTS["ignore_patterns"] = """
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations),
given AS (SELECT CASE length(l) % 5 WHEN 0 THEN concat(' # ', l) WHEN 1 THEN concat('  ', l, '/ ') ELSE l END AS v FROM l),
clean AS (SELECT regexp_replace(v, '^\\s+|\\s+$', '', 'g') AS v FROM given)
SELECT md5(regexp_replace(v, '/$', '/*')) AS pattern, count(*) AS n FROM clean
WHERE v <> '' AND NOT starts_with(v, '#') GROUP BY 1"""
STATEMENTS["decoded_files"] = """
SELECT doc_id,
    CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN octet_length(encode(text)) < 1023 WHEN 2 THEN true
      ELSE octet_length(encode(text)) + 1 < 1024 END AS is_binary,
    md5(replace(replace(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat('a', text, chr(0))
      WHEN 2 THEN concat(chr(0), text) ELSE concat(text, chr(10), chr(10), 'A') END,
      concat(chr(13), chr(10)), chr(10)), chr(13), chr(10))) AS digest
FROM documents"""
STATEMENTS["staged_findings"] = (
    _found(
        f"""SELECT concat(path, '/', doc_id) AS id, concat(text, chr(13), chr(10)) AS text
        FROM (SELECT *, {R.FILE_EXPR} AS path FROM ({PL.documents_sql('duckdb')}))
        WHERE doc_id % 9 > 1 AND doc_id % 4 <> 3
          AND {_selected("concat(path, '/', doc_id)", no_ignore=True)}"""
    )
    + f"SELECT {_ID}, line, kind, finding_id FROM found"
)
STATEMENTS["changed_files"] = """
SELECT doc_id AS path, sha256(CASE WHEN lang = 'en' THEN concat(text, '!') ELSE text END) AS version
FROM documents WHERE lang IN ('en', 'de')"""
STATEMENTS["diff_findings"] = (
    _found(
        f"SELECT concat('f', doc_id, '.py') AS id, text FROM ({PL.documents_sql('duckdb')}) WHERE lang = 'en'"
    )
    + f"SELECT {_ID}, line, kind, finding_id FROM found"
)
_URI = (
    "CASE WHEN starts_with({p}, '/') THEN 'file://' ELSE '' END || array_to_string(list_transform(string_split("
    "CASE WHEN starts_with({p}, '/') THEN {p} ELSE regexp_replace({p}, '^(\\./)+', '') END, '/'), "
    "lambda part: url_encode(part)), '/')"
)
STATEMENTS["artifact_uris"] = (
    f"SELECT doc_id, {_URI.format(p='path')} AS uri FROM (SELECT doc_id, {R.URI_PATH} AS path FROM documents)"
)

# --- history -------------------------------------------------------------------------------------

_PATCH = f"""
    patch AS ({PL.patch_sql('duckdb')}),
    headed AS (SELECT *, starts_with(line, '@@commit ') AS c, starts_with(line, 'diff --git ') AS d,
               regexp_matches(line, '^@@ -[0-9]+(,[0-9]+)? \\+[0-9]+(,[0-9]+)? @@') AS h FROM patch),
    state AS (SELECT *,
        last_value(CASE WHEN c OR d THEN 'out' WHEN h THEN 'in' END IGNORE NULLS) OVER w AS inside,
        last_value(CASE WHEN c OR d OR h THEN line_no END IGNORE NULLS) OVER w AS hunk,
        last_value(CASE WHEN c THEN substr(line, 10) END IGNORE NULLS) OVER w AS commit,
        last_value(CASE WHEN h THEN cast(regexp_extract(line, '\\+([0-9]+)', 1) AS int) END IGNORE NULLS) OVER w AS first_line,
        count(*) FILTER (WHERE c) OVER w - 1 AS rank
      FROM headed WINDOW w AS (PARTITION BY repo ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
    named AS (SELECT *, last_value(CASE WHEN c OR d THEN '' WHEN starts_with(line, '+++ ') AND inside <> 'in'
        THEN CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) ELSE '' END END IGNORE NULLS) OVER
        (PARTITION BY repo ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS path FROM state),
    added AS (SELECT *, substr(line, 2) AS body,
        first_line + row_number() OVER (PARTITION BY repo, hunk ORDER BY line_no) - 1 AS new_line
      FROM named WHERE inside = 'in' AND path <> '' AND starts_with(line, '+')),
    hunks AS (SELECT repo, commit, rank, path, hunk, first_line,
        string_agg(body, chr(10) ORDER BY line_no) || chr(10) AS text FROM added GROUP BY ALL)"""
_HUNK_FOUND = (
    f"WITH {_PATCH.strip()},\n"
    "    src AS (SELECT concat(path, '|', repo, '|', hunk) AS id, * FROM hunks),"
    + O.found_ctes()
    + """,
    seen AS (SELECT path AS file, f.line + first_line - 1 AS line, kind, commit, rank, repo, hunk, "start",
        sha256(concat(path, ':', kind, ':', value)) AS finding_id, value FROM found f JOIN src USING (id)),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY {scope} finding_id ORDER BY rank DESC, hunk, "start") AS n,
        (SELECT count(DISTINCT commit) FROM seen s WHERE s.finding_id = seen.finding_id {same}) - 1 AS others FROM seen)
"""
)
STATEMENTS["history_hunks"] = (
    f"WITH {_PATCH.strip()} SELECT repo, commit, rank, path, hunk, first_line, md5(text) AS digest FROM hunks"
)
STATEMENTS["history_added_lines"] = (
    f"WITH {_PATCH.strip()} SELECT repo, line_no, new_line, md5(body) AS digest FROM added"
)
STATEMENTS["history_first_seen"] = (
    _HUNK_FOUND.replace("{scope}", "repo,").replace("{same}", "AND s.repo = seen.repo")
    + """SELECT repo, file, line, kind, commit, nullif(others, 0) AS also_in_commits, finding_id FROM firsts WHERE n = 1"""
)
STATEMENTS["history_newest"] = (
    f"WITH {_PATCH.strip()} SELECT repo, commit, rank, path, first_line FROM hunks WHERE rank < 40"
)
STATEMENTS["history_limit"] = """
SELECT concat('r', conv_id % 4) AS repo, least(count(*), 140) AS commits_scanned, count(*) > 140 AS max_commits_reached
FROM conversations GROUP BY 1"""
STATEMENTS["history_under_path"] = (
    f"WITH {_PATCH.strip()} SELECT repo, commit, path, first_line FROM hunks WHERE path LIKE 'dir1/%'"
)

# --- reports ---------------------------------------------------------------------------------------

STATEMENTS["scan_summary"] = (
    _found()
    + _SIDES
    + """SELECT (SELECT count(*) FROM src) AS units_scanned,
    (SELECT count(*) FROM found WHERE finding_id NOT IN (SELECT id FROM old)) AS secrets_found,
    (SELECT count(*) FROM located) - (SELECT count(*) FROM found) AS inline_ignored,
    (SELECT count(*) FROM found WHERE finding_id IN (SELECT id FROM old)) AS ignored_by_baseline"""
)
STATEMENTS["json_summary"] = (
    _found()
    + """SELECT concat('{"files_scanned":', (SELECT count(*) FROM src), ',"secrets_found":', (SELECT count(*) FROM found),
    CASE WHEN n > 0 THEN concat(',"inline_ignored":', n) ELSE '' END, '}') AS value
    FROM (SELECT (SELECT count(*) FROM located) - (SELECT count(*) FROM found) AS n)"""
)
STATEMENTS["json_matches"] = (
    _found() + """SELECT concat('{"file":"', id, '","line":', line, ',"kind":"', kind, '"}') AS value FROM found"""
)
STATEMENTS["history_json_matches"] = (
    _HUNK_FOUND.replace("{scope}", "").replace("{same}", "")
    + """SELECT concat('{"file":"', file, '","line":', line, ',"kind":"', kind, '","commit":"', substr(commit, 1, 8), '"',
    CASE WHEN others > 0 THEN concat(',"also_in_commits":', others) ELSE '' END, '}') AS value FROM firsts WHERE n = 1"""
)
_CATALOG = "catalog(kind, label, category, level, severity, rule_id, rule_index) AS (VALUES " + ", ".join(
    [
        f"({O.quote(k)}, {O.quote(label)}, {O.quote(cat)}, {O.quote(level)}, {sev}::DOUBLE, 'hushscan.{k}', {i})"
        for i, (k, _, label, cat, level, sev, _, _) in enumerate(K.CATALOG)
    ]
    + [
        f"({O.quote(n)}, {O.quote(n)}, 'possible secret', 'error', 7.5::DOUBLE, 'hushscan.custom.{n.lower().replace(' ', '-')}', {20 + i})"
        for i, n in enumerate(R.CUSTOM)
    ]
) + ")"
STATEMENTS["findings_with_catalog"] = (
    _found(custom=R.CUSTOM) + f", {_CATALOG} "
    + f"""SELECT {_ID}, "start", "end", kind, label, category, level, severity, rule_id FROM found JOIN catalog USING (kind)"""
)
STATEMENTS["severity_rollup"] = (
    _found(custom=R.CUSTOM) + f", {_CATALOG} "
    + "SELECT category, level, count(*) AS findings FROM found JOIN catalog USING (kind) GROUP BY ROLLUP (category, level)"
)
STATEMENTS["language_cube"] = (
    _found()
    + "SELECT lang, kind, count(*) AS findings FROM found JOIN src USING (id) GROUP BY CUBE (lang, kind)"
)
STATEMENTS["gate_status"] = _found() + "SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS status FROM found"
_SARIF = (
    _found(_paths(), custom=R.CUSTOM) + f", {_CATALOG}, "
    + f"""rows AS (SELECT id AS file, kind, rule_id, rule_index, level,
    concat(CASE WHEN rule_index < 20 THEN concat('This looks like a credential: ', label, '.')
      ELSE concat('Match of the rule "', kind, '".') END,
      ' Revoke it at its issuer, then take it out of the text.') AS message,
    {_URI.format(p='id')} AS uri, line AS start_line, "column" AS start_column, end_line, end_column
    FROM found JOIN catalog USING (kind)) """
)
STATEMENTS["sarif_locations"] = _SARIF + "SELECT * FROM rows"
STATEMENTS["sarif_results"] = (
    _SARIF
    + """SELECT concat('{"ruleId":"', rule_id, '","ruleIndex":', rule_index, ',"level":"', level,
    '","message":{"text":"', replace(message, '"', '\\"'), '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"',
    uri, '"},"region":{"startLine":', start_line, ',"startColumn":', start_column, ',"endLine":', end_line,
    ',"endColumn":', end_column, '}}}]}') AS value FROM rows"""
)
STATEMENTS["sarif_log"] = (
    _SARIF
    + """, numbered AS (SELECT *, row_number() OVER (ORDER BY file, start_line, start_column, end_line, end_column, kind) - 1 AS n
    FROM rows)
    SELECT n // 50 AS log, n % 50 AS place, rule_id, uri, start_line FROM numbered"""
)
# slugs are lower case with one dash for each run of other characters; later names get the next free number
STATEMENTS["rule_id_collisions"] = """
WITH names AS (SELECT DISTINCT concat(source, unnest(['!', '?', ' ', '-2'])) AS name FROM documents),
ids AS (SELECT name, CASE WHEN name LIKE '%-2' THEN 2 ELSE 0 END AS given, regexp_replace(name, '(!|\\?| |-2)$', '') AS base,
    row_number() OVER (PARTITION BY regexp_replace(name, '(!|\\?| |-2)$', '') ORDER BY name) AS n FROM names)
SELECT name, concat('hushscan.custom.', base, CASE
    WHEN name LIKE '% ' THEN '' WHEN name LIKE '%!' THEN '-2'
    WHEN name LIKE '%-2' THEN '-2-2' ELSE '-3' END) AS rule_id FROM ids"""
STATEMENTS["scan_files"] = (
    _found(_paths()) + f"SELECT {_ID}, line, kind, finding_id FROM found WHERE NOT ends_with(id, '.rb')"
)
STATEMENTS["exclude_union"] = f"""
SELECT doc_id, path FROM (SELECT doc_id, {R.FILE_EXPR} AS path FROM documents)
WHERE {_selected('path', (), R.EXCLUDE)} AND NOT regexp_matches(path, '(?s)^src/[a-z0-9]*[37]/e.*$')
    AND NOT regexp_matches(path, '(?s)(^|/)f[^/]*$')"""

# --- triage -------------------------------------------------------------------------------------------

_CORE = (
    "CASE kind WHEN 'aws_secret_access_key' THEN coalesce(regexp_extract_all(value, '[A-Za-z0-9/+=]{40}')[-1], value) "
    "WHEN 'bearer_token' THEN regexp_replace(value, '(?i)^bearer\\s+', '') ELSE value END"
)
_NEEDLE = (
    "CASE WHEN contains({c}, chr(10)) THEN list_reduce(list_filter(string_split({c}, chr(10)), "
    "lambda l: NOT starts_with(l, '-----') AND trim(l) <> ''), "
    "lambda a, l: CASE WHEN length(l) > length(a) THEN l ELSE a END) ELSE {c} END"
)


def _sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else O.quote(str(v))


_PROVIDERS = "providers(kind, prefix, provider, credential, needs_rotation) AS (VALUES " + ", ".join(
    f"({_sql(p.kind)}, {_sql(p.prefix)}, {_sql(p.provider)}, {_sql(p.credential)}, {_sql(p.needs_rotation)})"
    for p in K.PROVIDERS
) + ")"
_GENERIC = (
    "CASE kind " + " ".join(f"WHEN {_sql(k)} THEN {_sql(v)}" for k, v in K.GENERIC_CREDENTIALS.items())
    + f" ELSE {_sql(K.GENERIC_CREDENTIAL)} END"
)


def _identified(source: str) -> str:
    """Rows of ``source`` with their provider: the longest matching prefix."""
    return f"""
    known AS (SELECT s.*, p.provider AS pv, p.credential AS cr, p.needs_rotation AS nr,
        row_number() OVER (PARTITION BY s.rid ORDER BY length(p.prefix) DESC) AS pick
      FROM {source} s LEFT JOIN providers p ON p.kind = s.kind AND starts_with(s.value, p.prefix)),
    guided AS (SELECT * EXCLUDE (pv, cr, nr, pick), coalesce(pv, 'Unknown provider') AS provider,
        coalesce(cr, {_GENERIC}) AS credential, coalesce(nr, true) AS needs_rotation, pv IS NOT NULL AS identified
      FROM known WHERE pick = 1)"""


def _credentials(source: str) -> str:
    return (
        _found(source) + f", {_PROVIDERS}, "
        + f"""numbered AS (SELECT row_number() OVER () AS rid, id AS file, line, "start", kind, value, {_CORE} AS core FROM found),"""
        + _identified("numbered").replace("known AS", "known_rows AS").replace("FROM known ", "FROM known_rows ")
        + """,
    chosen AS (SELECT *, row_number() OVER (PARTITION BY core ORDER BY identified DESC, file, line, "start") AS n FROM guided),
    places AS (SELECT DISTINCT core, file, line FROM guided),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY core ORDER BY file, line) AS n FROM places),
    spots AS (SELECT core, count(*) AS n_locations, min_by(concat(file, ':', line), n) AS first_location,
        string_agg(concat(file, ':', line), ',' ORDER BY n) FILTER (WHERE n <= 5) AS locations FROM ordered GROUP BY core),
    creds AS (SELECT sha256(core) AS credential_id, core, kind, provider, credential, needs_rotation, identified,
        first_location, locations, n_locations, greatest(n_locations - 5, 0) AS more_locations
      FROM chosen JOIN spots USING (core) WHERE n = 1)
"""
    )


STATEMENTS["credentials"] = _credentials(_paths()) + "SELECT * EXCLUDE (core) FROM creds"
STATEMENTS["credential_locations"] = (
    _credentials(_paths()) + "SELECT sha256(core) AS credential_id, file, line FROM places"
)
STATEMENTS["provider_counts"] = (
    _found(custom=R.CUSTOM) + f", {_PROVIDERS}, "
    + "numbered AS (SELECT row_number() OVER () AS rid, kind, value FROM found),"
    + _identified("numbered").replace("known AS", "known_rows AS").replace("FROM known ", "FROM known_rows ")
    + " SELECT provider, credential, identified, needs_rotation, count(*) AS findings FROM guided GROUP BY ALL"
)
STATEMENTS["core_values"] = (
    _found()
    + f"""SELECT {_ID}, "start", sha256(core) AS core, sha256({_NEEDLE.format(c='core')}) AS needle
    FROM (SELECT *, {_CORE} AS core FROM found)"""
)
# occurrences: one row per start, found by splitting at the literal
_REFS = """,
    refs AS (SELECT DISTINCT credential_id, file, length(head) - length(replace(head, chr(10), '')) + 1 AS line FROM (
      SELECT credential_id, id AS file, substr(text, 1, CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
          + (i - 1) * length(core) AS BIGINT)) AS head
      FROM (SELECT credential_id, core, d.id, text, string_split(text, core) AS p
            FROM creds c JOIN {texts} d ON contains(d.text, c.core)), unnest(range(1, len(p))) AS u(i)))
"""
STATEMENTS["leftover_references"] = (
    _credentials(_paths()) + _REFS.replace("{texts}", "src") + "SELECT * FROM refs"
)
_WORK = (
    _credentials(_paths())
    + _REFS.replace("{texts}", "src")
    + """, counted AS (SELECT credential_id, kind, needs_rotation, count(line) AS refs_remaining,
        regexp_matches(credential_id, '^[0-7]') AS revoked_reported
      FROM creds LEFT JOIN refs USING (credential_id) GROUP BY ALL),
    work AS (SELECT *, NOT needs_rotation OR (revoked_reported AND refs_remaining = 0) AS resolved FROM counted)
"""
)
STATEMENTS["rotation_worklist"] = _WORK + "SELECT * FROM work"
STATEMENTS["rotation_rollup"] = (
    _WORK
    + """SELECT count(*) AS credentials, count(*) FILTER (WHERE NOT resolved) AS unresolved,
    count(*) FILTER (WHERE NOT needs_rotation) AS no_rotation_needed, sum(refs_remaining)::BIGINT AS refs_remaining FROM work"""
)
_COMMITS = (
    _HUNK_FOUND.replace("{scope}", "").replace("{same}", "")
    + f""", cores AS (SELECT DISTINCT {_CORE} AS core FROM seen),
    hits AS (SELECT DISTINCT sha256(core) AS credential_id, repo, commit, rank FROM cores
             JOIN named ON contains(line, {_NEEDLE.format(c='core')}) AND NOT c)"""
)
STATEMENTS["history_commits"] = _COMMITS + " SELECT * FROM hits"
STATEMENTS["history_references"] = (
    _COMMITS
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY credential_id ORDER BY rank, repo, commit) AS n FROM hits)
    SELECT credential_id, count(*) AS history_commits,
      string_agg(substr(commit, 1, 8), ',' ORDER BY n) FILTER (WHERE n <= 5) AS commits FROM numbered GROUP BY 1"""
)

# --- fixes ----------------------------------------------------------------------------------------------

# The planted source lines are known, so their verdicts are written out by case.
_CODE = f"""SELECT {PL.PATH_EXPR} AS id, doc_id, source, {R.CODE_EXPR} AS text, {R.TOKEN} AS token,
    CASE WHEN doc_id % 5 IN (0, 4) THEN 'py' WHEN doc_id % 5 = 1 THEN 'js' WHEN doc_id % 5 = 2 THEN 'ts' ELSE 'rb' END AS ext
    FROM documents"""
_LANG_CASE = "CASE doc_id % 5 WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'TypeScript' WHEN 3 THEN 'rb' ELSE 'py' END"
_JUDGED = f""",
    judged AS (SELECT f.id AS file, doc_id, line, "start", kind, {_LANG_CASE} AS language,
        value = token AND ((ext = 'py' AND doc_id % 6 IN (0, 1, 5)) OR (ext IN ('js', 'ts') AND doc_id % 6 IN (2, 3))) AS fixable,
        CASE doc_id % 6 WHEN 0 THEN 'API_KEY' WHEN 1 THEN 'API_KEY' WHEN 2 THEN 'API_KEY'
          WHEN 3 THEN concat('MY', upper(source), '_KEY') WHEN 5 THEN 'API_KEY_2' END AS want,
        CASE doc_id % 6 WHEN 0 THEN concat('api_key = os.getenv(', chr(39)) WHEN 1 THEN '  apiKey = os.getenv("'
          WHEN 2 THEN 'const apiKey = process.env["' WHEN 3 THEN concat('export let my', source, 'Key: string = process.env["')
          WHEN 5 THEN 'apiKey_2 = os.getenv("' END AS h,
        CASE doc_id % 6 WHEN 0 THEN concat(chr(39), ')') WHEN 1 THEN '")' WHEN 5 THEN '")'
          ELSE concat('"]', CASE WHEN ext = 'ts' THEN '!' ELSE '' END, CASE doc_id % 6 WHEN 2 THEN ';' ELSE '' END) END AS t
      FROM found f JOIN src USING (id))
"""
STATEMENTS["fix_candidates"] = (
    _found(_CODE) + _JUDGED
    + """SELECT file, line, "start", kind, language, fixable, CASE WHEN fixable THEN want END AS desired,
    CASE WHEN fixable THEN h END AS head, CASE WHEN fixable THEN t END AS tail FROM judged"""
)
# Claims depend on earlier claims, so they are folded in order: a claim is the
# shortest free name given the names taken so far.
_CLAIMS = """,
    taken AS (SELECT concat('p', doc_id % 3) AS project, list(DISTINCT concat('API_KEY_', doc_id % 50)) AS names
              FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
    wanted AS (SELECT concat('p', doc_id % 3) AS project, list([want] ORDER BY file, "start") AS wants,
                      list({'f': file, 's': "start"} ORDER BY file, "start") AS keys FROM judged WHERE fixable GROUP BY 1),
    folded AS (SELECT project, keys, len(coalesce(names, [])) AS skip, list_reduce(wants, lambda a, x:
        a || [CASE WHEN NOT list_contains(a, x[1]) THEN x[1] ELSE
          list_filter(list_transform(range(2, len(a) + 3), lambda n: concat(x[1], '_', n)), lambda c: NOT list_contains(a, c))[1] END],
        coalesce(names, [])) AS claims FROM wanted LEFT JOIN taken USING (project)),
    claimed AS (SELECT project, keys[i].f AS file, keys[i].s AS "start", claims[skip + i] AS env_key
                FROM folded, unnest(range(1, len(keys) + 1)) AS u(i))
"""
STATEMENTS["fix_plan"] = (
    _found(_CODE) + _JUDGED + _CLAIMS
    + """SELECT concat('p', doc_id % 3) AS project, file, line, kind, fixable, env_key,
    CASE WHEN fixable THEN concat(h, env_key, t) END AS proposed_line FROM judged LEFT JOIN claimed c USING (file, "start")"""
)
STATEMENTS["env_names"] = f"""
WITH n AS (SELECT p_partkey, {R.NAME_EXPR} AS name FROM part),
s AS (SELECT p_partkey, regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'),
                                      '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g') AS name FROM n),
k AS (SELECT p_partkey, upper(trim(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS k FROM s)
SELECT p_partkey, CASE WHEN k = '' THEN 'SECRET_KEY' ELSE k END AS env_name FROM k"""

# --- lines and streams ----------------------------------------------------------------------------------------

STATEMENTS["line_reassembly"] = """
WITH whole AS (SELECT cast(conv_id AS varchar) AS stream_id, string_agg(text, '' ORDER BY turn) AS text
               FROM conversations GROUP BY 1),
parts AS (SELECT stream_id, i - 1 AS part, string_split(text, chr(10))[i] AS line, i = len(string_split(text, chr(10))) AS last
          FROM whole, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i))
SELECT stream_id, part, md5(concat(line, CASE WHEN last THEN '' ELSE chr(10) END)) AS digest
FROM parts WHERE NOT (last AND line = '')"""
STATEMENTS["stream_line_reassembly"] = """
WITH parts AS (SELECT conv_id, turn, i, string_split(text, chr(10))[i] AS line, i = len(string_split(text, chr(10))) AS last
               FROM conversations, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i))
SELECT cast(conv_id AS varchar) AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS ord,
    md5(concat(line, CASE WHEN last THEN '' ELSE chr(10) END)) AS digest
FROM parts WHERE NOT (last AND line = '')"""
STATEMENTS["stream_findings"] = (
    _found(_EVENTS) + f'SELECT {_ID}, line, "start", "end", kind, finding_id FROM found'
)
STATEMENTS["stream_first_seen"] = (
    _found(_EVENTS)
    + """SELECT DISTINCT event_type AS source_id, kind, sha256(concat(event_type, ':', kind, ':', value)) AS finding_id
    FROM found JOIN src USING (id)"""
)
STATEMENTS["alert_counts"] = (
    _found(_EVENTS)
    + """, timed AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, kind, ts FROM found JOIN src USING (id))
    SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, kind, count(*) AS findings FROM timed
    WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM timed) - INTERVAL 2 HOUR GROUP BY 1, 2"""
)
STATEMENTS["stream_alerts"] = (
    _with(_EVENTS, O.merged_ctes(), _REDACTED)
    + """SELECT cast(id AS varchar) AS source_id, 'potential secret detected and redacted' AS message
    FROM redacted WHERE was_redacted"""
)
STATEMENTS["quarantined_texts"] = (
    _with(_docs(), O.merged_ctes(), _REDACTED)
    + """SELECT id AS doc_id, id % 5 = 0 AS quarantined, CASE WHEN id % 5 <> 0 THEN md5(text) END AS digest FROM redacted"""
)
STATEMENTS["lines_with_literals"] = """
WITH needles AS (SELECT DISTINCT n FROM (SELECT unnest([regexp_extract(text, '^(\\S+ \\S+)', 1),
    regexp_extract(text, '(\\S+ \\S+)$', 1)]) AS n FROM conversations) WHERE n <> ''),
lines AS (SELECT conv_id, turn, i AS line_no, string_split(text, chr(10))[i] AS line
          FROM conversations, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i))
SELECT md5(n) AS needle, conv_id, turn, line_no FROM needles JOIN lines ON contains(line, n)"""

STATEMENTS["lines_with_many_literals"] = r"""
WITH needles AS (SELECT DISTINCT n FROM (SELECT substring(text, CAST(40 * i + 1 AS INT), 40) AS n
    FROM documents, unnest(range(0, length(text) // 40)) AS u(i)) WHERE NOT contains(n, chr(10))),
lines AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line
          FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
parts AS (SELECT DISTINCT doc_id, CAST(line_no AS INT) AS line_no, substring(line, CAST(i AS INT), 40) AS n
          FROM lines, unnest(range(1, length(line) - 38)) AS u(i))
SELECT md5(n) AS needle, doc_id, line_no FROM parts JOIN needles USING (n)"""
STATEMENTS["scrubbed_events"] = f"""
WITH known AS (SELECT DISTINCT concat('tok-', md5(concat(l_orderkey, '-', l_linenumber)), 'K') AS v FROM lineitem),
said AS (SELECT event_id, props, user_id, concat('tok-', md5(concat(event_id, '-', event_id % 8)), 'K') AS a,
                concat('tok-', md5(concat(user_id, '-1')), 'K') AS b FROM events)
SELECT event_id, concat(props, ' ', CASE WHEN a IN (SELECT v FROM known) THEN {_MASK} ELSE a END, ' by ', user_id, '; ',
                        CASE WHEN b IN (SELECT v FROM known) THEN {_MASK} ELSE b END) AS text FROM said"""

STATEMENTS["contested_env_keys"] = """
WITH claims AS (SELECT o_orderkey AS k, o_orderkey % 50 AS m FROM orders),
early AS (SELECT k FROM claims WHERE m = 0 AND k >= 2),
free AS (SELECT n, row_number() OVER (ORDER BY n) AS nth
         FROM (SELECT unnest(range(1, (SELECT 2 * count(*) + 10 FROM claims))) AS n)
         WHERE n <> 3 AND n NOT IN (SELECT k FROM early)),
plain AS (SELECT k, n FROM (SELECT k, row_number() OVER (ORDER BY k) AS nth FROM claims WHERE m > 1) JOIN free USING (nth))
SELECT 'a.py' AS file, k AS "start", concat('TOKEN_', k) AS env_key FROM claims WHERE m = 0
UNION ALL SELECT 'b.py', k, CASE WHEN n = 1 THEN 'TOKEN' ELSE concat('TOKEN_', n) END FROM plain
UNION ALL SELECT 'c.py', k, CASE WHEN k >= 2 AND (k IN (SELECT n FROM plain) OR k = 3)
    THEN concat('TOKEN_', k, '_2') ELSE concat('TOKEN_', k) END FROM claims WHERE m = 1"""
STATEMENTS["many_ignore_patterns"] = f"""
WITH listed AS (SELECT {R.IGNORED_EXPR} AS p FROM orders),
files AS (SELECT doc_id, path, string_split(path, '/')[-1] AS base FROM (SELECT doc_id, {R.FILE_EXPR} AS path FROM documents)),
gone AS (SELECT DISTINCT path FROM files JOIN listed ON path GLOB p OR base GLOB p)
SELECT doc_id, path FROM files WHERE path NOT IN (SELECT path FROM gone)"""
STATEMENTS["stream_first_commits"] = STATEMENTS["history_first_seen"]
STATEMENTS["merged_sketches"] = (
    _found() + "SELECT kind, count(DISTINCT finding_id) AS findings, true AS within_bound FROM found GROUP BY kind"
)
