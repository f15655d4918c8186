"""SQL text of the URL rules, written for DuckDB apart from the Spark expressions."""

from __future__ import annotations

from trellium.functions.urls import EXCLUDED_EXTENSIONS, EXCLUDED_HOST_PARTS, SCHEMES, TRACKING_PARAMS

_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}]+"
_RFC = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}', ''), '{_WS}$', '')"


def part_sql(x: str, n: int) -> str:
    return f"regexp_extract({x}, '{_RFC}', {n})"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def _encode(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def query_sql(q: str) -> str:
    pieces = f"list_filter(string_split({q}, '&'), lambda s: s <> '')"
    name, value = r"regexp_extract(s, '^([^=]*)', 1)", r"regexp_extract(s, '^[^=]*=?(.*)$', 1, 's')"
    kept = f"list_filter({pieces}, lambda s: NOT list_contains({_list(TRACKING_PARAMS)}, lower({_decode(name)})))"
    return f"array_to_string(list_transform({kept}, lambda s: {_encode(_decode(name))} || '=' || {_encode(_decode(value))}), '&')"


def path_sql(p: str) -> str:
    """For paths without '..' segments, which no table here has."""
    return f"(CASE WHEN starts_with({p}, '//') AND NOT starts_with({p}, '///') THEN '//' ELSE '/' END || array_to_string(list_filter(string_split({p}, '/'), lambda s: s <> '' AND s <> '.'), '/'))"


def clean_url_sql(raw: str) -> str:
    v = strip_sql(raw)
    scheme, host = f"lower({part_sql(v, 1)})", f"lower({part_sql(v, 2)})"
    path = f"regexp_replace({part_sql(v, 3)}, ';[^/]*$', '')"
    bad_host = " OR ".join(f"contains({host}, '{x}')" for x in EXCLUDED_HOST_PARTS)
    bad_file = " OR ".join(f"ends_with(lower({path}), '{x}')" for x in EXCLUDED_EXTENSIONS)
    query = query_sql(part_sql(v, 4))
    return f"""CASE WHEN list_contains({_list(SCHEMES)}, {scheme}) AND {host} <> '' AND NOT ({bad_host}) AND NOT ({bad_file})
      THEN {scheme} || '://' || {host} || {path_sql(path)} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"""
