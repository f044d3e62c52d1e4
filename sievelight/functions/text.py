"""Text helpers as SQL expressions over expressions of paths, URLs, texts and levels."""

from __future__ import annotations

from . import fixed
from .sql import array, in_list, lit


def file_name(path: str) -> str:
    """Last path component ('/' separated)."""
    return f"coalesce(nullif(regexp_extract({path}, '([^/]+)/*$', 1), ''), {path})"


def file_name_from_path(path: str) -> str:
    """Part after the last '/' or '\\', whatever system wrote the path."""
    return f"regexp_extract({path}, {lit(r'[^/\\]*$')}, 0)"


def file_stem(path: str) -> str:
    return f"regexp_replace({file_name(path)}, {lit(r'(?s)^(.+)\.[^.]*$')}, '$1')"


def file_extension(path: str) -> str:
    """Lower-case extension, empty for dot files and names without one."""
    return f"lower(regexp_extract({file_name(path)}, {lit(r'(?s)^.+\.([^.]*)$')}, 1))"


def normalize_file_stem(path: str) -> str:
    return f"regexp_replace(lower({file_stem(path)}), '[^a-z0-9]', ' ')"


def normalize_pua(text: str) -> str:
    return f"translate({text}, {lit(fixed.PUA_FROM)}, {lit(fixed.PUA_TO)})"


def suggestion_for(level: str) -> str:
    return (
        f"case when {in_list(level, ['critical', 'high'])} then {lit(fixed.SUGGESTION_HIGH)} "
        f"when {level} = 'medium' then {lit(fixed.SUGGESTION_MEDIUM)} "
        f"else {lit(fixed.SUGGESTION_LOW)} end"
    )


def risk_rank(level: str) -> str:
    """0..3 for low..critical, null for anything else."""
    arms = " ".join(f"when {lit(n)} then {i}" for i, n in enumerate(fixed.RISK_LEVELS))
    return f"(case {level} {arms} end)"


def risk_name(rank: str) -> str:
    return f"element_at({array(fixed.RISK_LEVELS)}, {rank} + 1)"


def is_builtin(category: str) -> str:
    return in_list(category, fixed.CATEGORIES)


def is_internet_url(url: str) -> str:
    """True/false for http(s) URLs outside/inside the local network, null for other input."""
    scheme = f"lower(regexp_extract({url}, {lit(r'^\s*([A-Za-z][A-Za-z0-9+.-]*)://')}, 1))"
    host_at = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
    host = f"lower(regexp_extract({url}, {lit(host_at)}, 1))"
    v4 = r"^(?:\d{1,3}\.){3}\d{1,3}$"
    local_v4 = r"^(?:10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|0\.0\.0\.0$)"
    local_v6 = (
        r"^\[(?:::1?|0*(?::0*){6}:0*1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]$"
    )
    return (
        f"case when {in_list(scheme, ['http', 'https'])} and {host} <> '' then not ({host} = 'localhost' "
        f"or endswith({host}, '.local') or ({host} rlike {lit(v4)} and {host} rlike {lit(local_v4)}) "
        f"or {host} rlike {lit(local_v6)}) end"
    )
