"""Secret scans by one deterministic automaton for all rules.

Every rule's regular expression becomes a small nondeterministic automaton over bytes; the subset
construction over all of them and minimisation give one transition array, and one pass over the
bytes tells where which rule has a match ending. Many stretches of text are stepped through side
by side, one array operation per byte position. A stretch may begin only after a byte that leads
every state back to the start, so no match crosses its border. Where a rule matched, its own
reversed automaton marks the starts and its own forward automaton the longest end.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

BATCH_BYTES = 4 << 20
LANE_BYTES = 1024


@dataclass(frozen=True)
class Rule:
    """`regex` over ASCII: literals, classes, groups, `|`, `?*+{m,n}`, `(?i:...)`. A match is kept if the
    Python pattern `keep` matches all of its bytes; matches that are not kept still take their text. A kept
    match goes on over what the Python pattern `tail` matches of the text behind it."""

    kind: str
    regex: str
    keep: str = ""
    tail: str = ""


# What follows the first line of a private key. With an END line: all up to it, as far as it is no prose (headers, escaped
# line breaks, quotes, marks of comments and markup may be between). Without: runs of base64 that are no words, and then
# what is left of a run on a line of its own or with padding. Outside the automaton, which stays small.
_GAP = r"""(?:[\x20\t-\r"'`,>#*|]|\\[nrt])"""
_END = r"-{5,}END\x20[A-Z\x20]*PRIVATE\x20KEY-----"
KEY_BODY = rf"""(?:[A-Za-z0-9+/=:,;&%_"'`#<>*|\\\x20\t-\r]++|-(?!----))*+{_END}|""" + (
    rf"(?:{_GAP}++(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_GAP}++[A-Za-z0-9+/]{{20,}}+=*+)++"
    rf"(?:{_GAP}++[A-Za-z0-9+/]++(?:={{1,2}}|(?=[\x20\t\"'`,]*(?:[\r\n\\]|\Z))))?")


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
         r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    Rule("access", r"AKIA[A-Z0-9]+", r"(?s:.{20,})"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Runs of these rules overlap those of the base, and each such rule about doubles the states.
MORE = (
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", tail=KEY_BODY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", r"(?s:.{40,})"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", r"(?s:.{15,})"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]+", r"(?s:.{39,})"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]+", r"(?s:.{24,})"),
)
RULES = BASE + MORE


class _Parser:
    """Regular expression to a tree of ('set', bytes), ('cat', parts), ('alt', parts), ('many', part, least, most)."""

    def __init__(self, regex: str):
        self.rest, self.fold = list(regex), False

    def parse(self):
        tree = self.alternatives()
        if self.rest:
            raise ValueError(f"unexpected {self.rest[0]!r}")
        return tree

    def take(self, what: str) -> bool:
        if "".join(self.rest[:len(what)]) == what:
            del self.rest[:len(what)]
            return True
        return False

    def alternatives(self):
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self):
        parts = []
        while self.rest and self.rest[0] not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.single()
        while self.rest and self.rest[0] in "?*+{":
            mark = self.rest.pop(0)
            if mark == "{":
                text = ""
                while not self.take("}"):
                    text += self.rest.pop(0)
                least, _, most = text.partition(",")
                part = ("many", part, int(least), int(most or least) if most or "," not in text else None)
            else:
                part = ("many", part, int(mark == "+"), 1 if mark == "?" else None)
        return part

    def single(self):
        if self.take("(?i:"):
            outer, self.fold = self.fold, True
            tree = self.alternatives()
            self.fold = outer
            return self.closed(tree)
        if self.take("(?:") or self.take("("):
            return self.closed(self.alternatives())
        if self.take("["):
            negative, chosen = self.take("^"), set()
            while not self.take("]"):
                low = self.one()
                if len(low) == 1 and self.rest[0] == "-" and self.rest[1] != "]":
                    self.rest.pop(0)
                    (high,) = self.one()
                    low = set(range(min(low), high + 1))
                chosen |= low
            chosen = self.cased(chosen)
            return ("set", frozenset(set(range(256)) - chosen if negative else chosen))
        if self.take("."):
            return ("set", frozenset(set(range(256)) - {10}))
        return ("set", frozenset(self.cased(self.one())))

    def closed(self, tree):
        if not self.take(")"):
            raise ValueError("group is not closed")
        return tree

    def one(self) -> set[int]:
        char = self.rest.pop(0)
        if char != "\\":
            return {ord(char)}
        char = self.rest.pop(0)
        digits, lower, upper = set(range(48, 58)), set(range(97, 123)), set(range(65, 91))
        named = {"d": digits, "w": digits | lower | upper | {95}, "s": {9, 10, 11, 12, 13, 32}}
        if char == "x":
            return {int(self.rest.pop(0) + self.rest.pop(0), 16)}
        return named.get(char) or {{"n": 10, "r": 13, "t": 9}.get(char, ord(char))}

    def cased(self, chosen: set[int]) -> set[int]:
        if not self.fold:
            return chosen
        text = bytes(sorted(b for b in chosen if b < 128))
        return chosen | set(text.lower()) | set(text.upper())


def _reversed(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reversed(p) for p in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [_reversed(p) for p in tree[1]])
    return ("many", _reversed(tree[1]), *tree[2:]) if kind == "many" else tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.accepts: dict[int, int] = {}

    def node(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Nodes for `tree` from `start` on; the node where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.node()
            self.edges[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.node()
            for part in tree[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.node()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        end = self.node()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end

    def closure(self, nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for other in self.empty[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        return frozenset(seen)


class Automaton:
    """Transition array [state, byte] of the trees; `accept[state]` has bit r set where tree r has a match ending.

    Searching: every byte may start a match. Else state 0 is the start and the last state a dead end.
    States are ordered so that those from `first_accept` on accept something.
    """

    def __init__(self, trees: list, searching: bool):
        nfa = _Nfa()
        root = nfa.node()
        for number, tree in enumerate(trees):
            start = nfa.node()
            nfa.empty[root].append(start)
            nfa.accepts[nfa.add(tree, start)] = 1 << number
        # Bytes that no set of the rules tells apart share a column.
        sets = list({chosen for edges in nfa.edges for chosen, _ in edges})
        alike: dict[tuple, int] = {}
        column = [alike.setdefault(tuple(byte in chosen for chosen in sets), len(alike)) for byte in range(256)]
        columns = {chosen: sorted({column[byte] for byte in chosen}) for chosen in sets}
        first = nfa.closure([root])
        states, rows, todo = {first: 0}, [], deque([first])
        closed: dict[frozenset, frozenset] = {}
        while todo:
            subset = todo.popleft()
            row = [set() for _ in alike]
            for node in subset:
                for chosen, target in nfa.edges[node]:
                    for k in columns[chosen]:
                        row[k].add(target)
            line = []
            for targets in row:
                key = frozenset(targets)
                if key not in closed:
                    closed[key] = nfa.closure(key | {root} if searching else key)
                subset_to = closed[key]
                if subset_to not in states:
                    states[subset_to] = len(states)
                    todo.append(subset_to)
                line.append(states[subset_to])
            rows.append(line)
        table = np.array(rows, np.int64)
        accept = np.array([sum({nfa.accepts[n] for n in subset if n in nfa.accepts}) for subset in states], np.int64)
        small, self.accept = _minimal(table, accept)
        self.table = small[:, column]
        self.first_accept = int(np.searchsorted(self.accept > 0, True))
        self.reset = (self.table == self.table[:1]).all(0) & (self.table[0] == 0) if searching else None


def _minimal(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no input tells apart (refinement of partitions), start first, accepting states last."""
    group = np.unique(accept, return_inverse=True)[1]
    while True:
        signature = np.column_stack([group, group[table]])
        _, finer = np.unique(signature, axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    _, sample = np.unique(group, return_index=True)
    order = sorted(range(len(sample)), key=lambda g: (accept[sample[g]] > 0, g != group[0], g))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keep = sample[order]
    return place[group[table[keep]]], accept[keep]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [_Parser(rule.regex).parse() for rule in rules]
        self.all = Automaton(trees, searching=True)
        if self.all.first_accept == 0:
            raise ValueError("a rule matches the empty text")
        self.forward = [Automaton([tree], searching=False) for tree in trees]
        self.backward = [Automaton([_reversed(tree)], searching=True) for tree in trees]
        self.keep = [re.compile(r.keep.encode()) if r.keep else None for r in rules]
        self.tail = [re.compile(r.tail.encode()) if r.tail else None for r in rules]
        self.alive = [(a.table != np.arange(len(a.table))[:, None]).any(1) | (a.accept > 0) for a in self.forward]
        _, byte_class = np.unique(self.all.table, axis=1, return_inverse=True)
        self.byte_class = byte_class.reshape(-1).astype(np.int32)
        classes = int(self.byte_class.max()) + 1
        sample = [int(np.flatnonzero(self.byte_class == c)[0]) for c in range(classes)]
        self.flat = (self.all.table[:, sample] * classes).astype(np.int32).reshape(-1)
        self.first_accept = self.all.first_accept * classes
        self.classes = classes
        self.all.table = None  # the flat array has it

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The byte pass: places at which matches end (inclusive), bits of their rules, places of reset bytes."""
        n = len(data)
        resets = np.flatnonzero(self.all.reset[data])
        grid = np.arange(LANE_BYTES, n, LANE_BYTES)
        at = np.searchsorted(resets, grid)
        begins = np.unique(np.concatenate([offsets[:-1], resets[at[at < len(resets)]] + 1]))
        begins = begins[begins < n]
        sizes = np.diff(np.append(begins, n))
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        coded = self.byte_class[data]
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left").tolist()
        state = np.zeros(len(begins), np.int32)
        places, bits = [], []
        for step, count in enumerate(live):
            where = begins[:count] + step
            own = state[:count]
            own += coded[where]
            own[:] = self.flat[own]
            if own.max() >= self.first_accept:
                hit = np.flatnonzero(own >= self.first_accept)
                places.append(where[hit])
                bits.append(self.all.accept[own[hit] // self.classes])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), resets
        return np.concatenate(places), np.concatenate(bits), resets

    def matches(self, number: int, part: bytes) -> list[tuple[int, int]]:
        """Leftmost longest matches of one rule, not overlapping, in a stretch between reset bytes."""
        back, state = self.backward[number], 0
        starts = []
        for i in range(len(part) - 1, -1, -1):
            state = back.table[state, part[i]]
            if state >= back.first_accept:
                starts.append(i)
        ahead, out, free = self.forward[number], [], 0
        for start in reversed(starts):
            if start < free:
                continue
            state, end = 0, start
            for i in range(start, len(part)):
                state = ahead.table[state, part[i]]
                if state >= ahead.first_accept:
                    end = i + 1
                elif not self.alive[number][state]:
                    break  # a dead end
            out.append((start, end))
            free = end
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """row -> (start, rule, end) in bytes of the row's text, ordered; rows without any are left out."""
        places, bits, resets = self.hits(data, offsets)
        out: dict[int, list[tuple[int, int, int]]] = {}
        if not len(places):
            return out
        row = np.searchsorted(offsets, places, "right") - 1
        after = np.searchsorted(resets, places)
        low = np.maximum(offsets[row], np.where(after > 0, resets[after - 1] + 1, 0) if len(resets) else 0)
        high = np.minimum(offsets[row + 1], resets[np.minimum(after, len(resets) - 1)] if len(resets) else len(data))
        high = np.where(after < len(resets), high, offsets[row + 1])
        todo: dict[tuple[int, int, int], int] = {}
        for key, mask in zip(zip(row.tolist(), low.tolist(), high.tolist()), bits.tolist()):
            todo[key] = todo.get(key, 0) | mask
        whole: dict[int, bytes] = {}
        for (i, a, b), mask in todo.items():
            part, base = data[a:b].tobytes(), a - int(offsets[i])
            for number in range(len(self.rules)):
                if mask >> number & 1:
                    for start, end in self.matches(number, part):
                        if self.keep[number] is None or self.keep[number].fullmatch(part[start:end]):
                            last = base + end
                            if self.tail[number]:
                                if i not in whole:
                                    whole[i] = data[offsets[i]:offsets[i + 1]].tobytes()
                                more = self.tail[number].match(whole[i], last)
                                last = more.end() if more else last
                            out.setdefault(i, []).append((base + start, number, last))
        for found in out.values():
            found.sort()
        return out


@lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, redact: bool = False) -> DataFrame:
    """Add `spans`, the secrets in `text` (code points, end exclusive), ordered by start, then rule.

    All columns stay; `redact` replaces each secret in `text` by its kind in brackets (overlapping
    ones by the kind of the first). A null text has no spans and stays null; a column of the input
    named `spans` is replaced. Rows may repeat.
    """
    names = [c for c in documents.columns if c != "spans"]
    rows = documents.select(*[f"`{c}`" for c in names])
    kinds = [rule.kind for rule in rules]
    shared = scanner(rules)  # built once, here
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in slices(batches, "text", BATCH_BYTES):
            data, offsets = text_bytes(batch.column("text"))
            spans = shared.spans(data, offsets)
            columns = {name: batch.column(name) for name in names}
            lines, texts = [[]] * batch.num_rows, {}
            for i, found in spans.items():
                own = data[offsets[i]:offsets[i + 1]]
                points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                lines[i] = [
                    {"kind": kinds[r], "start": int(points[a]), "end": int(points[b])} for a, r, b in found]
                if redact:
                    raw, parts, done = own.tobytes(), [], 0
                    for a, r, b in found:
                        if a >= done:
                            parts += [raw[done:a], f"[{kinds[r]}]".encode()]
                        done = max(done, b)
                    texts[i] = b"".join([*parts, raw[done:]]).decode()
            if texts:
                changed = np.zeros(batch.num_rows, bool)
                changed[list(texts)] = True
                new = pa.array([texts[i] for i in sorted(texts)], pa.string())
                columns["text"] = pc.replace_with_mask(pc.cast(columns["text"], pa.string()), pa.array(changed), new)
            yield pa.record_batch([*columns.values(), pa.array(lines, pa.list_(item))], [*names, "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, spans {SPANS}")


def digests(documents: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base kinds, and all spans as text."""
    base = [rule.kind for rule in BASE]
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(documents.select("doc_id", "text")).select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"))
