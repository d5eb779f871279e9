"""URL canonical form as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import TRACKING_PARAMS
from .text import SPACE, bind

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PREFIX = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"


def _decode(part: Column) -> Column:
    """Percent decoding that leaves stray percent signs alone."""
    return F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(part: Column) -> Column:
    encoded = F.url_encode(part)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(raw: Column, drop: Sequence[str]) -> Column:
    """Re-encoded query string without the tracking parameters."""
    pairs = F.transform(
        F.filter(F.split(raw, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", ""))
                    .otherwise(F.lit(""))).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(list(drop)))
    return F.array_join(
        F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def normalize_url(url: Column, drop: Sequence[str] = tuple(TRACKING_PARAMS)) -> Column:
    """Canonical URL: lower-case host, no tracking parameters, trailing slash or fragment."""
    trimmed = F.regexp_replace(url, f"^[{SPACE}]+|[{SPACE}]+$", "")
    parts = lambda t: F.struct(
        t.alias("given"),
        F.lower(F.regexp_extract(t, _SCHEME, 1)).alias("scheme"),
        F.lower(F.regexp_extract(t, _HOST, 1)).alias("host"),
        F.regexp_extract(t, _PREFIX + r"([^?#]*)", 1).alias("path"),
        F.regexp_extract(t, r"^[^?#]*\?([^#]*)", 1).alias("query"))
    flat = F.regexp_replace(trimmed, r"[\t\r\n]", "")
    unbalanced = lambda p: F.contains(p["host"], F.lit("[")) != F.contains(p["host"], F.lit("]"))
    clean = bind(bind(flat, parts), lambda p: F.when(~unbalanced(p), _rebuilt(p, drop)))
    return F.when(url.isNull() | (url == ""), F.lit("")).otherwise(F.coalesce(clean, trimmed))


def _rebuilt(part: Column, drop: Sequence[str]) -> Column:
    path = F.regexp_extract(part["path"], r"^((?:.*/)?[^/;]*)", 1)
    params = F.regexp_extract(part["path"], r"^(?:.*/)?[^/;]*;(.*)$", 1)
    prefixed = lambda mark, value: F.when(value != "", F.concat(F.lit(mark), value)).otherwise(F.lit(""))
    query = F.when(part["query"] == "", F.lit("")).otherwise(_query(part["query"], drop))
    return F.concat(
        F.when(part["scheme"] != "", F.concat(part["scheme"], F.lit(":"))).otherwise(F.lit("")),
        prefixed("//", part["host"]),
        bind(path, lambda p: F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))),
        bind(params, lambda v: prefixed(";", v)),
        bind(query, lambda v: prefixed("?", v)))


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)\??#.*$|\?$", "")
