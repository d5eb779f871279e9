"""Language identification by a bidirectional gated recurrent network over bytes.

The text is read in windows of bytes, in both directions; every position gets a probability for
each language from the two states beside it, and a document's probabilities are the means over
all its positions. The network is trained here, in numpy, by backpropagation through time.

A direction's step, with x the byte's row of an input table and h the state before:
    z = hard(x_z + U_z h), r = hard(x_r + U_r h), c = clip(x_c + r * (U_c h), -1, 1)
    h' = h + z * (c - h)
where hard(v) = clip(v / 4 + 1/2, 0, 1). The piecewise linear gates cost a fraction of exp and tanh.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

HIDDEN = 8
WINDOW = 128  # bytes that are read in one go; the state starts anew in each window
LANES = 4096
BATCH_BYTES = 2 << 20
SAMPLE = 1500  # training documents, chosen by a hash of doc_id
PIECE = 20_000  # code points of a training text that are used
TRAIN_WINDOW = 48
TRAIN_BATCH = 96
STEPS = 500
UNKNOWN = "und"


def _hard(v: np.ndarray) -> np.ndarray:
    return np.clip(v * 0.25 + 0.5, 0, 1, out=v)


class Network:
    """Parameters as float32 arrays: per direction E (3H, 256), U (3H, H), b (3H); output W (L, 2H), c (L)."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = len(languages)
        self.languages, self.hidden = languages, hidden
        self.p: dict[str, np.ndarray] = {}
        for way in ("f", "b"):
            self.p["E" + way] = rng.normal(0, 0.4, (3 * hidden, 256)).astype(np.float32)
            self.p["U" + way] = rng.normal(0, 0.5 / hidden**0.5, (3 * hidden, hidden)).astype(np.float32)
            self.p["b" + way] = np.repeat([-1.0, 0.0, 0.0], hidden).astype(np.float32)[:, None]
        self.p["W"] = rng.normal(0, 0.3, (size, 2 * hidden)).astype(np.float32)
        self.p["c"] = np.zeros((size, 1), np.float32)

    def states(self, x: np.ndarray, way: str, keep: bool = False):
        """x: bytes (positions, lanes). The state after each position; `keep` also what training needs."""
        h3, (steps, lanes) = self.hidden, x.shape
        table = self.p["E" + way] + self.p["b" + way]
        u = self.p["U" + way]
        h = np.zeros((h3, lanes), np.float32)
        out = np.empty((steps, h3, lanes), np.float32)
        kept = []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = np.take(table, x[t], axis=1)
            v = u @ h
            gates = a[:2 * h3]
            gates += v[:2 * h3]
            before = gates.copy() if keep else None
            _hard(gates)
            z, r = gates[:h3], gates[h3:]
            c = r * v[2 * h3:]
            c += a[2 * h3:]
            raw = c.copy() if keep else None
            np.clip(c, -1, 1, out=c)
            if keep:
                kept.append((t, h, before, z, r, v[2 * h3:], raw, c))
            new = out[t]
            np.subtract(c, h, out=new)
            new *= z
            new += h
            h = new
        return (out, kept) if keep else out

    def logits(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """(positions, languages, lanes). The byte at a position is in both states."""
        w, h = self.p["W"], self.hidden
        return w[:, :h] @ forward + w[:, h:] @ backward + self.p["c"]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        logits = self.logits(self.states(x, "f"), self.states(x, "b"))
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradient. label: language of each lane."""
        hidden, p = self.hidden, self.p
        forward, kept_f = self.states(x, "f", keep=True)
        backward, kept_b = self.states(x, "b", keep=True)
        logits = self.logits(forward, backward)
        logits -= logits.max(1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(1, keepdims=True)
        steps, lanes = x.shape
        loss = float(-np.log(q[:, label, np.arange(lanes)] + 1e-12).mean())
        d = q
        d[:, label, np.arange(lanes)] -= 1
        d /= steps * lanes
        grads = {name: np.zeros_like(value) for name, value in p.items()}
        grads["c"] = d.sum((0, 2))[:, None]
        grads["W"][:, :hidden] = np.einsum("tln,thn->lh", d, forward, optimize=True)
        grads["W"][:, hidden:] = np.einsum("tln,thn->lh", d, backward, optimize=True)
        for way, kept, w in (("f", kept_f, p["W"][:, :hidden]), ("b", kept_b, p["W"][:, hidden:])):
            u, du, de = p["U" + way], grads["U" + way], grads["E" + way]
            dh = np.zeros((hidden, lanes), np.float32)
            da = np.empty((3 * hidden, lanes), np.float32)
            dv = np.empty_like(da)
            for t, h, before, z, r, vc, raw, c in reversed(kept):
                dh = dh + w.T @ d[t]
                dz = dh * (c - h) * 0.25
                dc = dh * z * (np.abs(raw) < 1)
                dr = dc * vc * 0.25
                inside = np.abs(before) < 2
                da[:hidden], da[hidden:2 * hidden], da[2 * hidden:] = dz, dr, dc
                da[:2 * hidden] *= inside
                dv[:2 * hidden] = da[:2 * hidden]
                dv[2 * hidden:] = dc * r
                du += dv @ h.T
                one = np.zeros((lanes, 256), np.float32)
                one[np.arange(lanes), x[t]] = 1
                de += da @ one
                dh = dh * (1 - z) + u.T @ dv
            grads["b" + way] = de.sum(1, keepdims=True)
        return loss, grads


def train(texts: list[bytes], labels: list[int], languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on random windows of the texts; every window's positions have its text's language."""
    net, rng = Network(languages, seed=seed), np.random.default_rng(seed)
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    by_label = [[i for i, x in enumerate(labels) if x == k] for k in range(len(languages))]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for step in range(1, steps + 1):
        x = np.full((TRAIN_WINDOW, TRAIN_BATCH), 32, np.uint8)
        label = rng.integers(0, len(languages), TRAIN_BATCH)
        for lane, k in enumerate(label):
            own = arrays[by_label[k][rng.integers(len(by_label[k]))]]
            start = rng.integers(max(1, len(own) - TRAIN_WINDOW + 1))
            part = own[start:start + TRAIN_WINDOW]
            x[:len(part), lane] = part
        _, grads = net.gradients(x, label)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        rate = 0.02 * (1 - step / (steps + 1)) + 0.0005
        for k, g in grads.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over all positions of each text; zeros for a text without bytes."""
    sizes = np.diff(offsets)
    windows = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = offsets[text] + inside * WINDOW
    size = np.minimum(WINDOW, offsets[text + 1] - begin)
    sums = np.zeros((len(sizes), len(net.languages)))
    # Lanes of one size run together, so that no window is padded.
    order = np.argsort(-size, kind="stable")
    start = 0
    while start < len(order):
        n = int(size[order[start]])
        stop = min(start + LANES, int(np.searchsorted(-size[order], -n, "right")))
        lanes = order[start:stop]
        x = data[begin[lanes][None, :] + np.arange(n)[:, None]]
        np.add.at(sums, text[lanes], net.probabilities(x).sum(0).T)
        start = stop
    return sums / np.maximum(sizes, 1)[:, None]


def fit(documents: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Network | None:
    """Train on about `sample` rows of (doc_id, text, lang) with a language and a text, at most that many, with the
    smallest hashes. None without any such row.

    A count over the narrow columns gives the share of rows that is looked at, so that the tasks together
    send little more than the sample to the driver. Of a long text one piece takes part, from a hashed place.
    """
    known = documents.where(F.col("lang").isNotNull())
    share = min(1.0, 1.5 * sample / max(1, known.select("doc_id").count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rows = known.where(place < int(share * (1 << 30))).where(F.length("text") > 0).withColumn(
        "h", F.xxhash64("doc_id", "text"))
    piece = F.substring("text", F.pmod("h", F.greatest(F.length("text") - PIECE, F.lit(0)) + 1).cast("int") + 1, PIECE)
    rows = rows.select("h", "lang", piece.alias("text")).orderBy("h", "lang").limit(sample).collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    return train([r["text"].encode() for r in rows], [languages.index(r["lang"]) for r in rows], languages, steps)


@lru_cache(2)
def _network(raw: bytes) -> Network:
    return pickle.loads(raw)


def predict(documents: DataFrame, net: Network | None) -> DataFrame:
    """Add lang_pred and score (the mean probability of that language) to the rows of `documents`.

    A text that is null or has no letter is `und` with score 0; without a network all are. Every
    byte of a text counts. All columns stay, but ones of these names are replaced; rows may repeat.
    """
    names = [c for c in documents.columns if c not in ("lang_pred", "score")]
    rows = documents.select(*[f"`{c}`" for c in names])
    if net is None:
        return rows.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    raw = pickle.dumps(net)

    def run(batches):
        net = _network(raw)
        for batch in slices(batches, "text", BATCH_BYTES):
            means = document_probabilities(net, *text_bytes(batch.column("text")))
            best = means.argmax(1)
            yield pa.record_batch(
                [*[batch.column(n) for n in names], pa.array([net.languages[i] for i in best], pa.string()),
                 pa.array(np.clip(means.max(1), 0, 1), pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    labelled = rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return labelled.withColumn("score", F.when(letters, F.col("score")).otherwise(0.0)).withColumn(
        "lang_pred", F.when(letters, F.col("lang_pred")).otherwise(UNKNOWN))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digests(documents: DataFrame) -> DataFrame:
    """Predictions for all rows by a network that saw only rows that are not held out."""
    net = fit(documents.select("doc_id", "text", "lang").where(~held_out()))
    return predict(documents.select("doc_id", "text"), net).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
