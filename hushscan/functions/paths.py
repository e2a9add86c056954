"""File-selection predicates on a path column."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# --- Fixed values: what counts as scannable text, and what is skipped -----------
SCANNED_EXTENSIONS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".html", ".htm", ".css", ".scss", ".vue", ".svelte",
    ".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".sh", ".bash", ".zsh",
    ".ps1", ".bat", ".cmd", ".xml", ".md", ".txt", ".sql", ".graphql", ".gql",
)
SKIPPED_DIRECTORIES = (
    ".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", "coverage",
    ".pytest_cache", ".mypy_cache", ".tox", "egg-info",
)


def _character_class(body: str, negated: bool) -> str:
    """The characters of a bracket; a range that runs backwards holds none."""
    parts, i = [], 0
    while i < len(body):
        ends = body[i] + body[i + 2] if body[i + 1 : i + 2] == "-" and i + 2 < len(body) else body[i]
        i += 2 * len(ends) - 1
        if ends[0] <= ends[-1]:
            parts.append("-".join(re.sub(r"[\\\[\]&~|^-]", r"\\\g<0>", c) for c in ends))
    if parts:
        return f"[{'^' * negated}{''.join(parts)}]"
    return "." if negated else "(?!)"


def glob_to_regex(pattern: str) -> str:
    """Shell glob as an anchored Java regex; ``*`` and ``?`` cross ``/``."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        i += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            body_at = i + 1 if pattern[i : i + 1] == "!" else i
            close = pattern.find("]", body_at + 1)
            if close < 0:
                out.append(r"\[")
                continue
            out.append(_character_class(pattern[body_at:close], negated=body_at > i))
            i = close + 1
        else:
            out.append(re.escape(char))
    return r"(?s)\A" + "".join(out) + r"\z"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Extension with its dot; empty for ``name``, ``.name`` and ``name.``."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1)


_FOLD = 100


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    """Does the path or its last part match a glob?  Long lists stay a short plan:
    plain names become one set, other globs a regex per hundred."""
    globs = list(dict.fromkeys(globs))
    names = [g for g in globs if not re.search(r"[*?\[]", g)]
    regexes = [glob_to_regex(g) for g in globs if re.search(r"[*?\[]", g)]
    hit = F.lit(False)
    if names:
        hit = path.isin(*names) | base_name(path).isin(*names)
    for i in range(0, len(regexes), _FOLD):
        folded = "|".join(f"(?:{r})" for r in regexes[i : i + _FOLD])
        hit = hit | path.rlike(folded) | base_name(path).rlike(folded)
    return hit


def is_selected(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Exclude wins; then an include list decides alone; then extension or name."""
    include, exclude = tuple(include), tuple(exclude)
    if include:
        chosen = matches_any(path, include)
    else:
        name, extension = base_name(path), suffix(path)
        chosen = (
            F.lower(extension).isin(*SCANNED_EXTENSIONS)
            | (extension == "")
            | (name == ".env")
            | F.startswith(name, F.lit(".env."))
        )
    return chosen & ~matches_any(path, exclude) if exclude else chosen


def in_skipped_directory(path: Column) -> Column:
    return F.arrays_overlap(
        F.split(path, "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRECTORIES])
    )


def is_meta_file(path: Column, names: Iterable[str]) -> Column:
    return base_name(path).isin(*names)


def artifact_uri(path: Column) -> Column:
    """Percent-encoded URI reference; absolute paths become ``file:`` URIs."""
    absolute = F.startswith(path, F.lit("/"))
    relative = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    encoded = F.url_encode(F.when(absolute, path).otherwise(relative))
    for java, plain in (("%2F", "/"), ("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(java), F.lit(plain))
    return F.when(absolute, F.concat(F.lit("file://"), encoded)).otherwise(encoded)
