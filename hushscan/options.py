"""Immutable settings shared by all operators."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from hushscan.functions import patterns as P


@dataclass(frozen=True)
class Options:
    entropy_threshold: float = P.DEFAULT_ENTROPY_THRESHOLD
    mask: str = P.DEFAULT_MASK
    #: switch for redaction and alerts; off passes text through untouched
    enabled: bool = True
    notify: bool = True
    #: text before ``ignore`` / ``ignore-next-line`` in an inline marker
    marker_prefix: str = "hushscan:"
    #: user rules as (name, Java pattern); see ``operators.rules.compile_rules``
    rules: tuple[tuple[str, str], ...] = ()
    apply_placeholders: bool = True
    apply_markers: bool = True
    #: names of the engine's own configuration files, skipped by default
    meta_files: tuple[str, ...] = (
        ".hushscan-rules.toml", "hushscan.toml", ".hushscanignore", ".hushscan-baseline.json",
    )
    rule_prefix: str = "hushscan."
    tool_name: str = "hushscan"
    ignore_paths: tuple[str, ...] = field(default=())
    include_patterns: tuple[str, ...] = field(default=())
    output_format: str | None = None

    def but(self, **changes) -> "Options":
        return replace(self, **changes)

    def for_redaction(self) -> "Options":
        """Redaction honours no placeholder list, marker or custom rule."""
        return replace(self, rules=(), apply_placeholders=False, apply_markers=False)

    def for_staged(self) -> "Options":
        """Pre-commit check: built-in rules only, no ignore lists."""
        return replace(self, rules=(), ignore_paths=(), include_patterns=())


def load_options(path: str | Path, base: Options = Options()) -> Options:
    """Settings from a TOML file; anything unreadable leaves the defaults in place."""
    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return base

    def table(parent, name: str) -> dict:
        value = parent.get(name, {}) if isinstance(parent, dict) else {}
        return value if isinstance(value, dict) else {}

    def strings(value) -> tuple[str, ...]:
        return tuple(str(v) for v in value) if isinstance(value, list) else ()

    scan = table(data, "scan")
    changes: dict = {
        "ignore_paths": strings(table(scan, "ignore").get("paths")),
        "include_patterns": strings(table(scan, "include").get("patterns")),
        "output_format": table(data, "output").get("format"),
    }
    try:
        changes["entropy_threshold"] = float(scan["entropy_threshold"])
    except (KeyError, TypeError, ValueError):
        pass
    return replace(base, **changes)
