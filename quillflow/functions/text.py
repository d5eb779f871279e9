"""Text cleaning as column expressions."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import AUTHOR_LIMIT, TITLE_LIMIT

# Unicode white space, spelled out because `\s` means something else in each regex engine.
SPACE = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD = r"\p{L}\p{N}_"

# Comments and hidden elements in one pattern: whichever opens first covers the other.
_UNSEEN = r"(?is)<!--.*?-->|<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\z)"
_TAG = r"(?s)</?[A-Za-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*>"
_BROKEN_TAG = r"</?[A-Za-z][^>]*>"

_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)"
_LEGACY = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
_LEGACY_PREFIX = "^(" + "|".join(_LEGACY) + ")"
# What browsers read for the numeric references 128-159: the Windows code page where it has a
# character, the code itself in its five gaps.
_GAPS = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_CP1252 = {
    str(code): chr(code) if code in _GAPS else bytes([code]).decode("cp1252")
    for code in range(0x80, 0xA0)
}


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`.

    It is the start of a fold over nothing: unlike an element of a one-element array, neither it nor the result is copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def _literal_map(entries: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def _code_point(number: Column) -> Column:
    control = (number.between(0x1, 0x8)) | (number.between(0xE, 0x1F)) | (
        number.between(0x7F, 0x9F)) | (number.between(0xFDD0, 0xFDEF)) | (number == 0xB) | (
        (number % 65536) >= 0xFFFE)
    mapped = F.try_element_at(_literal_map(_CP1252), number.cast("string"))
    return (
        F.when(number == 13, F.lit("\r"))
        .when(mapped.isNotNull(), mapped)
        .when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), F.lit("\ufffd"))
        .when(control, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def _number(digits: Column) -> Column:
    """Value of a numeric reference; anything longer than nine digits is out of range anyway."""
    hexadecimal = F.lower(digits).startswith("x")
    body = F.regexp_replace(F.regexp_replace(digits, "^[xX]", ""), "^0+(?=.)", "")
    value = F.when(hexadecimal, F.conv(body, 16, 10)).otherwise(body)
    return F.when(F.length(body) > 9, F.lit(0x110000).cast("bigint")).otherwise(value.cast("bigint"))


def _decode_piece(piece: Column) -> Column:
    """Decode the reference at the start of a piece that followed an ampersand."""
    return bind(F.regexp_extract(piece, _REFERENCE, 1), lambda ref: _decode_reference(piece, ref))


def _decode_reference(piece: Column, ref: Column) -> Column:
    rest = F.substr(piece, F.length(ref) + 1)
    named = _literal_map(html.entities.html5)
    legacy = F.regexp_extract(ref, _LEGACY_PREFIX, 1)
    # Each table look-up walks through the table, so it is done once.
    return bind(F.try_element_at(named, ref), lambda known: (
        F.when(ref == "amp;", F.concat(F.lit("&"), rest))
        .when(ref == "quot;", F.concat(F.lit('"'), rest))
        .when(ref == "lt;", F.concat(F.lit("<"), rest))
        .when(ref == "gt;", F.concat(F.lit(">"), rest))
        .when(ref.startswith("#"), F.concat(
            bind(_number(F.regexp_replace(ref, "[#;]", "")), _code_point), rest))
        .when(known.isNotNull(), F.concat(known, rest))
        .when(legacy != "", F.concat(
            F.try_element_at(named, legacy), F.substr(piece, F.length(legacy) + 1)))
        .otherwise(F.concat(F.lit("&"), piece))
    ))


def unescape(text: Column) -> Column:
    """HTML character references, named and numeric, decoded once in one pass."""
    decoded = lambda t: F.array_join(
        F.transform(F.split(t, "&"), lambda p, i: F.when(i == 0, p).otherwise(_decode_piece(p))), "")
    return bind(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def clean_title(title: Column, limit: int = TITLE_LIMIT) -> Column:
    """Readable one-line title; null when nothing is left."""
    cleaned = collapse(unescape(title))
    return F.nullif(F.substring(cleaned, 1, limit), F.lit(""))


def html_to_text(markup: Column) -> Column:
    """Visible text of an HTML fragment, one blank between parts."""
    visible = F.regexp_replace(markup, _UNSEEN, " ")
    bare = F.regexp_replace(F.regexp_replace(visible, _TAG, " "), _BROKEN_TAG, " ")
    return collapse(unescape(bare))


def clean_author(author: Column, limit: int = AUTHOR_LIMIT) -> Column:
    edges = f"^[{SPACE}]+|[{SPACE}]+$"
    return F.when(author != "", F.substring(F.regexp_replace(author, edges, ""), 1, limit))


def canonical_text(text: Column) -> Column:
    """Lower case, letters, digits and single blanks only."""
    return F.coalesce(
        collapse(F.regexp_replace(F.lower(text), f"[^{WORD}{SPACE}]", "")), F.lit(""))


def content_hash(title: Column, summary: Column) -> Column:
    """Version-2 signature of an article's title and summary."""
    payload = F.concat(F.lit("v2|"), canonical_text(title), F.lit("|"), canonical_text(summary))
    return F.sha2(payload, 256)
