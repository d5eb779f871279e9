"""Chat formatting, top-k search and the pipeline against plain versions."""

import random
from collections import defaultdict

import brute
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quillflow.llm import chat, topk

ROWS = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    frame = brute.clashing(spark.createDataFrame(rows, ROWS)).withColumn("parts", chat.text_part(F.col("text")))
    return frame.repartition(3)


def test_conversations_come_back(spark):
    odd = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "\\1 \\\\ [", "", None, "a\n\nb", "é<日", "\\0\\1\\2", "y" * 50_000]
    rng, rows = random.Random(1), []
    for conv in range(40):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "to\nol<"]), rng.choice(odd)))
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]
    rows += [(None, None, None, None), (None, None, None, "x"), (101, None, "user", "first"), (101, 0, "assistant", "b"),
             (101, 0, "assistant", "b"), (101, 0, "assistant", "a")]
    got = {r["conv_id"]: r for r in chat.digests(formatted(spark, rows)).collect()}
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((-1 if turn is None else turn, role or "", chat_escape(text or ""), text or ""))
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        if any("\n" in t[1] for t in turns):
            continue  # a role of several lines can't be told apart from its text
        turns.sort()
        r, loss = got[conv], "".join(t[3] for t in turns if t[1] == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == brute.sha("".join(f"{t[1]}\n{t[3]}\n" for t in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))


def chat_escape(text):
    return text.replace("\\", "\\0").replace("<", "\\1").replace("[", "\\2")


def test_no_control_string_comes_from_a_text(spark):
    row = chat.format_conversations(formatted(spark, [(1, 0, "user", "<|end|></s>[INST]<|image:x|>")])).first()
    assert row["formatted"].count("<|") == 2 and "[" not in row["formatted"] and "</s>" not in row["formatted"]


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None: (kind, text, ref, w, h)
    rows = [(1, 0, "user", [part("text", "see "), part("image", None, "a.png", 56.0, 29.0), part("text", "<x>"),
                            part("audio", None, "b<.wav", 2.5, None), part("document", None, None, 3.0, None)]),
            (1, 1, "assistant", [part("text", "yes")]), (1, 2, "user", None), (2, 0, "user", [])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_conversations(frame).collect()}
    one = got[1]
    assert one["formatted"].startswith("<|turn|>user\nsee <|image:a.png|>\\1x><|audio:b\\1.wav|><|document:|><|end|>\n")
    assert [(a["turn"], a["position"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [
        (0, 1, "image", "a.png", 4), (0, 3, "audio", "b<.wav", 63), (0, 4, "document", None, 1536)]
    assert one["expanded_tokens"] == 4 + 63 + 1536 and len(one["loss_spans"]) == 1
    span = one["loss_spans"][0]
    assert one["formatted"][span["start"]:span["end"]] == "yes"
    assert got[2]["formatted"] == "<|turn|>user\n<|end|>\n" and got[2]["attachments"] == []


def test_no_conversations(spark):
    assert chat.digests(formatted(spark, [(1, 0, "user", "x")]).where("false")).count() == 0


def brute_top(rows, k=5):
    good = [(i, np.floor(np.array(v, float) * 256)) for i, v in rows if i is not None and v is not None and all(
        x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in good)
    ids, matrix = np.array([i for i, _ in good]), np.array([np.pad(v, (0, width - len(v))) for _, v in good]).astype(np.int64)
    out = []
    for q in np.flatnonzero(ids % 50 == 0):
        scores = matrix @ matrix[q]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]][:k]
        out += [(int(ids[q]), rank, int(ids[j]), int(scores[j])) for rank, j in enumerate(order, 1)]
    return sorted(out)


def top(spark, rows):
    frame = brute.clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(5)
    return sorted(tuple(r) for r in topk.digests(frame).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("spread", [0.05, 1.0, 3000.0])
def test_top_k_is_exact(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 16))
    rows = [(i, (spread * (centres[i % 5] + rng.normal(size=16))).astype(np.float32).tolist()) for i in range(700)]
    assert top(spark, rows) == brute_top(rows)


def test_top_k_ties_nulls_and_odd_vectors(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(300)] + [
        (1000, None), (1001, [0.1, None, 0.3]), (1002, [float("nan"), 1.0, 1.0]), (1050, [float("inf"), 0.0, 0.0]),
        (1100, [0.0, 0.0, 0.0]), (1101, [-0.001, 0.0, 0.0]), (None, same), (1150, [1.0]), (1151, [1.0, 1.0, 1.0, 9.0]), (1200, [])]
    assert top(spark, rows) == brute_top(rows)


def test_few_or_no_vectors(spark):
    assert top(spark, [(50, [1.0, 2.0])]) == []
    assert top(spark, [(50, [1.0]), (51, [2.0])]) == [(50, 1, 51, 256 * 512)]
    assert top(spark, [(51, [2.0])]) == []
    assert top(spark, [(50, None)]) == []


# --- Pipeline --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after every stage over the smallest documents."""
    import corpus_pipeline

    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    extra = spark.createDataFrame([(90_001, "12345 --", None, "src0", 8), (90_002, None, "en", None, None)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SMALL)
        done.write.parquet(f"{folder}/{name}")
        done = spark.read.parquet(f"{folder}/{name}")
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in done.collect()], docs.columns, done.columns)
        docs = done
    return out


def test_stages_return_documents(stages):
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "secret_scan", "packing"]
    for name, (_, after, before_columns, columns) in stages.items():
        assert name == "packing" or columns == before_columns
        assert name == "packing" or all(r["n_chars"] == len(r["text"]) for r in after)


def test_language_stage_keeps_clean_documents(stages):
    before, after, *_ = stages["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {90_001, 90_002}


def test_line_stage_matches_brute_force(stages):
    from quillflow.llm import lines

    before, after, *_ = stages["line_dedup"]
    want = brute.without_boilerplate([(r["source"], r["text"]) for r in before], lines.RATIO, lines.LEAST_PAGES)
    assert {r["doc_id"]: r["text"] for r in after} == {r["doc_id"]: t for r, t in zip(before, want)}


def test_near_stage_matches_brute_force(stages):
    before, after, *_ = stages["near_dedup"]
    found = brute.near_components([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {d for d, c in found.items() if d == c}


def test_secret_stage_leaves_no_base_secret(stages):
    before, after, *_ = stages["secret_scan"]
    texts = {r["doc_id"]: r["text"] for r in after}
    assert set(texts) == {r["doc_id"] for r in before}
    for r in before:
        found = brute.secret_spans(r["text"])
        assert not any(r["text"][a:b] in texts[r["doc_id"]] for _, a, b in found)
        assert found or texts[r["doc_id"]] == r["text"] or "[" in texts[r["doc_id"]]


def test_packing_stage(stages):
    before, after, *_ = stages["packing"]
    library = brute.tokenizer()
    assert sum(r["length"] for r in after) == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before)
    assert len({r["sequence_id"] for r in after}) <= -(-sum(r["length"] for r in after) // 2048) + 2


def test_run_gives_the_packing(spark, stages):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_repeated_rows_leave_one(spark):
    import corpus_pipeline

    text = "one two three four five six seven"
    rows = spark.createDataFrame(
        [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (3, None, None, None, None),
         (4, "", "en", "s", 0)], brute.DOC_SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, brute.clashing(rows), SMALL).collect()
    assert sorted(r["doc_id"] or -1 for r in got) == [-1, 1, 3, 4]


def test_a_text_of_its_own_stays_though_its_doc_id_has_a_copy(spark):
    import corpus_pipeline

    text, own = "one two three four five six seven", "quite another text with words of its very own"
    rows = [(0, text, "en", "s", 1), (3, text, "en", "s", 1), (3, own, "en", "s", 1), (3, own, "de", "s", 1), (3, own.upper(), "en", "s", 1),
            (5, "", "en", "s", 0), (5, "", "en", "s", 0), (7, own + " and", "en", "s", 2), (None, own, "en", "s", 1)]
    docs = spark.createDataFrame(rows, brute.DOC_SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, brute.clashing(docs), SMALL).collect()), key=str)
    assert len(got) == 5 and [g for g in got if g[0] in (0, 5, None)] == [(0, text), (5, ""), (5, ""), (None, own)]
    assert [g[1].lower() for g in got if g[0] == 3] == [own]


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_near_dedup_shuffles_texts_once(spark, threshold):
    """One exchange carries the texts, whether joins are broadcast or not."""
    import corpus_pipeline

    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, threshold)
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        plan = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    wide = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "_key" in line]
    assert plan.count("Scan parquet") == plan.count("FileScan parquet") == 2 and 1 <= len(wide) <= 2
    assert sum("text#" in line for line in plan.split("\n") if "FileScan" in line) == 1


def test_stages_take_no_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], brute.DOC_SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SMALL)
        assert done.count() == 0
        docs = docs if name == "packing" else done
