"""BPE, packing and token files against the tokenizers library."""

import random
from collections import defaultdict

import brute
import numpy as np
import pytest

from quillflow.llm import ans, bpe, packing

random.seed(5)
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "don't we're 'llama ''s 'this  x"), (5, "a" * 3000), (6, "é日本語 ١٢ naïve"),
    (7, "x<|endoftext|>y <|endoftext|>"), (8, "same text"), (8, "same text"), (None, "no id"), (None, None),
    (9, "".join(random.choice("aabehtnio rstee'0-=  \n") for _ in range(60_000))), (10, "=-" * 40), (11, "​\x85\x1c b")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return brute.clashing(spark.createDataFrame(ODD, SCHEMA)).repartition(3).cache()


def expected(text, end=()):
    return brute.tokenizer().encode(text or "", add_special_tokens=False).ids + list(end)


def test_prefix_encoder_is_exact_on_random_words():
    encoder, library = bpe.encoder(brute.VOCABULARY), brute.tokenizer()
    for _ in range(1500):
        word = "".join(random.choice("abcdehilnorst") for _ in range(random.randrange(1, 25)))
        assert encoder.word(word.encode()) == library.encode(word, add_special_tokens=False).ids


def test_repeated_letters():
    encoder, library = bpe.encoder(brute.VOCABULARY), brute.tokenizer()
    for n in range(1, 70):
        assert encoder.word(b"a" * n) == library.encode("a" * n, add_special_tokens=False).ids


def test_digests(odd):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(
        odd, brute.VOCABULARY).collect())
    want = []
    for doc_id, text in ODD:
        ids = expected(text)
        decoded = brute.tokenizer().decode(ids, skip_special_tokens=False)
        want.append((doc_id or -1, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(decoded)))
    assert got == sorted(want)


def test_round_trip(odd):
    back = bpe.decode(bpe.encode(odd, brute.VOCABULARY), brute.VOCABULARY).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back) == sorted((d or -1, t or "") for d, t in ODD)


def test_invalid_bytes_are_replaced(spark):
    rows = spark.createDataFrame([(1, bytearray([200, 0, 0, 0]))], "doc_id long, ids binary")
    text = bpe.decode(rows, brute.VOCABULARY).first()["text"]
    assert text == brute.tokenizer().decode([200], skip_special_tokens=False)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.digests(none, brute.VOCABULARY).count() == 0
    assert packing.pack(none, brute.VOCABULARY).count() == 0


def check_packing(rows, documents, capacity):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for doc_id, text in documents:
        ids, at = expected(text, [0]), 0
        for k, r in enumerate(sorted(pieces[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == brute.crc_of(ids[at:at + r["length"]])
            at += r["length"]
        assert at == len(ids) and (len(ids) > capacity or len(pieces[doc_id]) == 1)
    return len(sequences)


def test_packing(odd):
    rows = packing.pack(odd, brute.VOCABULARY, capacity=256).collect()
    total = defaultdict(int)
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 256
    assert sum(total.values()) == sum(len(expected(t, [0])) for _, t in ODD)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_packing_gives_ids(spark):
    documents = [(i, "word " * random.randrange(1, 300)) for i in range(200)]
    rows = packing.pack(spark.createDataFrame(documents, SCHEMA).repartition(5), brute.VOCABULARY, with_ids=True)
    rows = rows.collect()
    used = check_packing(rows, documents, 2048)
    assert used == -(-sum(r["length"] for r in rows) // 2048)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)


def test_plan_uses_every_piece_and_few_sequences():
    for _ in range(30):
        histogram = {random.randrange(1, 101): random.randrange(1, 30) for _ in range(random.randrange(1, 40))}
        fillings, used = packing.plan(histogram, 100), defaultdict(int)
        for filling in fillings:
            assert sum(filling.lengths) <= 100 and filling.times > 0
            for length in filling.lengths:
                used[length] += filling.times
        assert dict(used) == histogram
        first_fit = best_fit_decreasing(histogram, 100)
        assert sum(f.times for f in fillings) <= first_fit + 1


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_plan_finds_the_exact_fit_of_skewed_lengths(n):
    histogram = {1088: n, 520: n, 440: n, 948: n, 560: n, 540: n, 400: n, 824: 2 * n}
    fillings, used = packing.plan(histogram), defaultdict(int)
    for filling in fillings:
        assert sum(filling.lengths) <= 2048 and filling.times > 0
        for length in filling.lengths:
            used[length] += filling.times
    assert dict(used) == histogram and packing.sequences(fillings) == 3 * n


def test_plan_is_between_the_bound_and_best_fit_decreasing():
    for _ in range(20):
        histogram = {random.randrange(1, 101): random.randrange(1, 30) for _ in range(random.randrange(1, 25))}
        counts = np.zeros(101, np.int64)
        counts[list(histogram)] = list(histogram.values())
        best_fit = best_fit_decreasing(histogram, 100)
        assert packing.sequences(packing.best_fit(counts, 100)) == best_fit
        assert packing.least_sequences(counts, 100) <= packing.sequences(packing.plan(histogram, 100)) <= best_fit


def best_fit_decreasing(histogram, capacity):
    room: list[int] = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fitting = [i for i, r in enumerate(room) if r >= length]
        if fitting:
            room[min(fitting, key=lambda i: room[i])] -= length
        else:
            room.append(capacity - length)
    return len(room)


def test_token_files(odd, spark, tmp_path):
    folder = str(tmp_path / "ids")
    ans.write(odd, brute.VOCABULARY, folder, block_ids=1000, partitions=3)
    rows = ans.read(spark, folder).orderBy("start").collect()
    want = sorted(ODD, key=lambda d: -1 if d[0] is None else d[0])
    assert [r["doc_id"] for r in rows] == [d for d, _ in want]
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    by_id = {d: t for d, t in ODD if d not in (None, 8)}
    for r in rows:
        if r["doc_id"] in by_id:
            assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in expected(by_id[r["doc_id"]], [2]))
    crc = {r["doc_id"]: r["ids_crc32"] for r in ans.digests(spark, folder).collect()}
    assert all(crc[d] == brute.crc_of(expected(t, [2])) for d, t in by_id.items())


def test_empty_token_file(spark, tmp_path):
    folder = str(tmp_path / "ids")
    ans.write(spark.createDataFrame([], SCHEMA), brute.VOCABULARY, folder)
    assert ans.read(spark, folder).count() == 0


def test_blocks_round_trip_and_damage_is_seen():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 511, 512, 513, 70_000, 200_001):
        ids = (rng.geometric(0.001, n) % 50_000).astype(np.uint32)
        counts = np.bincount(np.append(ids, 7), minlength=1 << 16)
        coder = ans.Coder(ans.scaled(counts))
        block = coder.encode(ids)
        assert (coder.decode(block) == ids).all()
    damaged = bytearray(block)
    damaged[-9] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(damaged))


def test_one_symbol_only():
    import numpy as np

    ids = np.full(3000, 2, np.uint32)
    coder = ans.Coder(ans.scaled(np.bincount(ids, minlength=1 << 16)))
    assert (coder.decode(coder.encode(ids)) == ids).all()


def test_scaled_frequencies():
    import numpy as np

    for counts in ([1] * 50_000, [10**12] + [1] * 40_000, [0, 3], [5]):
        freq = ans.scaled(np.array(counts))
        assert freq.sum() == 1 << ans.SCALE_BITS and ((freq > 0) == (np.array(counts) > 0)).all()
