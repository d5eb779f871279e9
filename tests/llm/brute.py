"""Plain versions of the operators, one document at a time, for comparison."""

from __future__ import annotations

import collections
import hashlib
import re
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside; an input may have such columns.
CLASH = ["ids", "spans", "rank", "task", "length", "node", "a", "b", "start", "pool", "kept", "line", "site", "_key",
         "lang_pred", "score", "dropped_lines", "component_id", "part", "id", "v", "formatted", "content"]


def sha(text) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def tokenizer() -> Tokenizer:
    return Tokenizer.from_file(VOCABULARY)


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def clashing(rows):
    from pyspark.sql import functions as F

    return rows.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in rows.columns])


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def shingle_set(text: str | None, lower=True) -> frozenset:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    words = re.findall("[^ \t-\r]+", text)
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_components(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable over links of similarity 0.75 or more."""
    sets = collections.defaultdict(list)
    for doc_id, text in docs:
        sets[doc_id].append(shingle_set(text))
    holders = collections.defaultdict(set)
    for doc_id, own in sets.items():
        for s in own:
            for shingle in s:
                holders[shingle].add(doc_id)
    root = {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for doc_id, own in sets.items():
        for other in {j for s in own for x in s for j in holders[x] if j < doc_id}:
            for s in own:
                for t in sets[other]:
                    n = len(s & t)
                    if s and t and 100 * n >= 75 * (len(s) + len(t) - n):
                        a, b = find(doc_id), find(other)
                        root[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def without_boilerplate(rows: list[tuple[str | None, str | None]], ratio: float, least: int) -> list[str | None]:
    """Texts of (site, text) without their sites' frequent lines."""
    pages, counts = collections.Counter(), collections.Counter()
    for site, text in rows:
        if site is not None:
            pages[site] += 1
            counts.update({(site, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for site, text in rows:
        if site is None or text is None:
            out.append(text)
            continue
        bad = lambda x: counts[site, x.strip(" ")] >= least and counts[site, x.strip(" ")] > pages[site] * ratio
        kept = [x for x in text.split("\n") if not x.strip(" ") or not bad(x)]
        out.append("\n".join(kept) if any(x.strip(" ") for x in kept) else text)
    return out
