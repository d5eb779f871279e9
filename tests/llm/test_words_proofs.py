"""Spelling variants, Merkle manifests and toxicity against plain versions."""

import collections
import glob
import os
import random
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.llm import manifest, queries, spelling, toxicity

SCHEMA = "doc_id long, text string"


def frame(spark, rows, schema=SCHEMA):
    return brute.clashing(spark.createDataFrame(rows, schema)).repartition(3)


# --- Spelling --------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def typed_words(rows, every=199):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return counts


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def told(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows.collect()}


@pytest.mark.parametrize("pairs", [5, 60, 1 << 19])
def test_lists_find_all_pairs_one_edit_apart(pairs):
    rng = random.Random(pairs)
    for _ in range(60):
        lists = [sorted({"".join(rng.choice("abÿ") for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 30))})
                 for _ in range(3)]
        flat = [w for words in lists for w in words]
        of = np.array([i for i, words in enumerate(lists) for _ in words])
        word, near, shared = spelling.near_pairs(of, flat, pairs)
        want = sorted((i, j) for i in range(len(flat)) for j in range(len(flat))
                      if of[i] == of[j] and i != j and one_edit(flat[i], flat[j]))
        assert sorted(zip(word.tolist(), near.tolist())) == want
        assert all(len(os.path.commonprefix([flat[i], flat[j]])) == k for i, j, k in zip(word, near, shared))


@pytest.mark.parametrize("most", [2, 7, 1024])
def test_variants_match_brute_force_however_lists_are_split(spark, most):
    rng = random.Random(4)
    counts = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8]))): rng.choice([5, 6, 30, 200, 5000]) for _ in range(350)}
    counts |= {"z" * 40 + c: 9 for c in "abcd"} | {"z" * 41: 50}
    got = told(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), most=most))
    assert got == plain_variants(counts)


def test_words_of_texts_with_slips(spark):
    rng = random.Random(5)
    base = ["Garden", "gardén", "gardens", "water", "WATERS", "straße", "Übung", "übungen", "a", "x×y÷zabc", "notÿwords"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", ".", "-", "'s", "7", "中"]) for _ in range(400))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "12 %%"), (3, rows[3][1]), (None, rows[4][1]), (103, "q" * 70_000), (104, "Ab" * 9)]
    want = {w: n for w, n in typed_words(rows, 7).items() if len(w) >= 6}
    got = {r["word"]: r["n"] for r in spelling.words(frame(spark, rows), every=7).collect()}
    assert got == want
    want = {w: n for w, n in typed_words(rows).items() if len(w) >= 6 and n >= 5}
    assert told(spelling.digests(frame(spark, rows))) == plain_variants(want)


def test_spelling_of_nothing(spark):
    assert spelling.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.digests(frame(spark, [(1, None), (2, "")])).count() == 0


# --- Manifest --------------------------------------------------------------------------------------


def plain_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return brute.sha("".join(spell(v) for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves, fanout):
    """Root, and per leaf its steps (others before it, others after it)."""
    at, steps, nodes = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i - i % fanout
            steps[leaf].append((nodes[first:i], nodes[i + 1:first + fanout]))
        nodes = [brute.sha("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], steps


def plain_manifest(rows, fanout=2):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[name] = plain_tree([plain_leaf(r) for r in groups[name]], fanout)
    root, tops = plain_tree([trees[n][0] for n in names], fanout)
    out = []
    for name, top in zip(names, tops):
        for row, own in zip(groups[name], trees[name][1]):
            steps = own + top
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = plain_leaf(row, 1 if hit else 0)
            for before, after in steps:
                folded = brute.sha("".join([*before, folded, *after]))
            proof = brute.sha("".join("".join(before + after) for before, after in steps))
            out.append((row[0], plain_leaf(row), trees[name][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def manifest_rows():
    rng = random.Random(6)
    rows = [(i, f"text {i} " + "é" * (i % 5), rng.choice(["en", "en", "en", "de", None, "zü"]), rng.choice(["s", None]),
             rng.choice([i, None])) for i in range(150)]
    rows += [(None, "no id", "en", "s", 1), (None, None, "en", None, None), (7, "other text of 7", "en", "s", 3), rows[9], rows[9]]
    rows += [(900, "", "", "", 0), (901, "y" * 300_000, "de", "s", 300_000), (902, "alone", "only", "s", 5), (-5, "less", "en", "s", 4)]
    return rows


def test_manifest_matches_plain_trees(spark):
    rows = manifest_rows()
    got = manifest.digests(frame(spark, rows, brute.DOC_SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == plain_manifest(rows)
    changed = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None}
    assert {r[0] for r in found if not r[6]} == changed and changed


@pytest.mark.parametrize("fanout", [3, 5])
def test_wider_runs(spark, fanout):
    rows = manifest_rows()
    got = manifest.manifest(frame(spark, rows, brute.DOC_SCHEMA), fanout).select(
        "doc_id", "leaf", "subroot", "root", manifest.folded(F.col("leaf"), F.col("path")).alias("folded")).collect()
    want = sorted(((r[0], r[1], r[2], r[3]) for r in plain_manifest(rows, fanout)), key=str)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=str) == want
    assert all(r["folded"] == r["root"] for r in got)


def test_small_manifests(spark):
    assert manifest.digests(spark.createDataFrame([], brute.DOC_SCHEMA)).count() == 0
    for rows in ([(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, "b", None, "s", 1)], [(3, "a", "x", "s", 1)] * 3):
        found = sorted((tuple(r) for r in manifest.digests(spark.createDataFrame(rows, brute.DOC_SCHEMA)).collect()), key=str)
        assert found == plain_manifest(rows)


def test_many_equal_rows_are_numbered_over_several_partitions(spark):
    rows = spark.range(0, 60_000, 1, 12).select(F.lit("g").alias("g"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = manifest.numbered(rows, "g", ["v"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got.agg(F.count_distinct("idx"), F.min("idx"), F.max("idx"), F.max("n")).first()[:] == (60_000, 0, 59_999, 60_000)
    root = spark.conf.get("spark.checkpoint.dir")
    newest = max(glob.glob(f"{root}/sorted-*"), key=os.path.getmtime)
    sizes = [r["count"] for r in spark.read.parquet(newest).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 20_000


# --- Toxicity --------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, words", [
    ("You IDIOT!", ["you", "idiot"]), ("1d10t m0r0n", ["idiot", "moron"]), ("$tupid l0$er", ["stupid", "loser"]),
    ("ѕtupіd", ["stupid"]), ("ｔｒａｓｈ", ["trash"]), ("id​i­ot", ["idiot"]), ("móron", ["moron"]),
    ("scυm", ["scum"]), ("50 of 1999", ["50", "of", "1999"]), ("wait!!! $5", ["wait", "5"]),
    ("of$$$ the***", ["of", "the"]), (None, []), ("", []), ("Übel été", ["übel", "été"]), ("id!ot", ["idiot"]), ("日本 語", ["日本", "語"])])
def test_folding(text, words):
    assert toxicity.fold(text) == words


def test_exceptions_and_longest_entries():
    lexicon = toxicity.Lexicon({"trash": 2.0, "clown": 1.0, "clowns": 3.0}, ["trash can", "clown fish"])
    total = lambda text: sum(w for _, w in lexicon.hits(toxicity.fold(text)))
    assert total("the trash can is full") == 0 and total("trash trash can") == 2 and total("trash, can you") == 0
    assert total("clowns clown clowning uptrash") == 5 and total("clown fish clowns") == 3 and total("") == 0


def toxic_rows(n=900):
    rng = random.Random(11)
    plain = [f"{a}{b}" for a in "ba de fi go lu mi no pa ru so ta vi".split() for b in "ner lin mast dor ket".split()]
    bad = ["grobnik", "zupfel", "idiot"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(30, 200))]
        toxic = i % 5 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "s", "en"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_is_learned_and_held_out_labels_are_not_used(spark):
    rows, labels = toxic_rows()
    more = [(2000, "gr0bnik und zupfel"), (2001, None), (2002, ""), (2003, "x" * 200_000), (None, "zupfel grobnik idiot"), (3, rows[5][1])]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    docs = frame(spark, rows + more)
    lied = [(i, 1 - t if held(i) else t) for i, t in labels]  # held-out labels turned round change nothing
    got = {}
    for told_labels in (labels, lied):
        table = frame(spark, told_labels + [(None, 1), (4000, None), (1, 7)], "doc_id long, toxic int")
        found = toxicity.digests(docs, table)
        assert found.columns == ["doc_id", "held_out", "score", "predicted"]
        got[told_labels is lied] = sorted(((r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in found.collect()), key=str)
    assert got[False] == got[True] and len(got[True]) == len(rows) + len(more)
    by_id = {r[0]: r for r in got[False] if r[0] not in (3, None)}
    assert all(r[1] == held(r[0]) and 0 <= r[2] <= 1 and r[3] == (r[2] >= 0.3) for r in got[False])
    tested = [(i, t) for i, t in labels if held(i) and i != 3]
    assert len(tested) > 150 and all(by_id[i][3] == t for i, t in tested)
    assert by_id[2000][3] == 1 and by_id[2001][3] == by_id[2002][3] == by_id[2003][3] == 0
    assert [r[3] for r in got[False] if r[0] is None] == [1]


def test_words_of_one_copied_document_do_not_become_entries(spark):
    rows, labels = toxic_rows(300)
    copied = " ".join(f"rare{i}word" for i in range(60)) + " idiot zupfel"
    rows += [(5000 + i, copied + f" end{i}") for i in range(60)]
    labels += [(5000 + i, 1) for i in range(60)]
    lexicon = toxicity.learn(frame(spark, rows), frame(spark, labels, "doc_id long, toxic int"))
    assert not any(e.startswith("rare") for e in lexicon.weights)
    assert any("zupfel".startswith(e) for e in lexicon.weights)


def test_without_labels_the_list_stands_alone(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.digests(frame(spark, [(1, "you idiot, you moron"), (2, "fine words"), (3, None)]), none).collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3)] == [1, 0, 0]
    assert toxicity.digests(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_new_queries_on_the_small_tables(spark):
    from compare import differences, oracle_connection
    from conftest import SMALL

    assert differences(spark, oracle_connection(SMALL), SMALL, "op12_manifest", queries.QUERIES["op12_manifest"],
                       queries.ORACLES["op12_manifest"]) is None
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {w: n for w, n in typed_words(rows).items() if len(w) >= 6 and n >= 5}
    assert told(queries.QUERIES["op11_spelling"](spark, SMALL)) == plain_variants(want)
    assert queries.QUERIES["op13_toxicity"](spark, SMALL).count() == len(rows)
