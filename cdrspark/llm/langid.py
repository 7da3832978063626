"""Language identification by a bidirectional gated recurrent network over bytes.

Each byte picks its gate inputs from a table, one GRU runs forwards and one backwards, and a softmax over both states
labels every position; a document's probabilities are the mean over all its positions. A document is scanned in windows
of `WINDOW` bytes side by side; each scan begins `MARGIN` bytes before its window (or where the text begins or ends, with no
state), so a position's states have read at least that many bytes on both sides. The network is trained in numpy by backpropagation through
time on a bounded sample: `sample_docs` documents of each language, `sample_windows` windows of each.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every document if no
labelled one is there to learn from; null languages don't train; texts count whole, in UTF-8;
equal texts get equal results; lang, source and doc_id are no inputs; other columns pass through, but
for those named like the results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cdrspark.llm.common import from_texts, id_remainder

WINDOW, MARGIN = 128, 32
#: Windows that run side by side: their states stay in a core's cache.
TOGETHER = 1024
UNKNOWN = "und"


@dataclass
class BiGru:
    """Weights of both directions. Gates are r, z, n in this order; arrays are (..., features, windows)."""

    languages: list[str]
    inputs: list[np.ndarray]  # for each direction (256, 3H): what a byte adds to the gates, biases included
    states: list[np.ndarray]  # (3H, H)
    labels: list[np.ndarray]  # (C, H)
    bias: np.ndarray  # (C, 1)

    @property
    def hidden(self) -> int:
        return self.states[0].shape[1]

    def params(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, *self.labels, self.bias]

    def scan(self, codes: np.ndarray, way: int, inside: np.ndarray | None = None) -> np.ndarray:
        """States (T, H, B) of one direction over codes (T, B). Where inside (T, B) is 0 there is no text, and states are 0."""
        h_n, (steps, width) = self.hidden, codes.shape
        half = np.ones(3 * h_n, np.float32)
        half[: 2 * h_n] = 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        table, u = self.inputs[way] * half, self.states[way] * half[:, None]
        h, out = np.zeros((h_n, width), np.float32), np.empty((steps, h_n, width), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            x = table[codes[t]].T
            g = u @ h
            gates = g[: 2 * h_n]
            gates += x[: 2 * h_n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            n = g[2 * h_n :]
            n *= gates[:h_n]
            n += x[2 * h_n :]
            np.tanh(n, out=n)
            h -= n
            h *= gates[h_n:]
            h += n
            if inside is not None:
                h *= inside[t]
            out[t] = h
        return out

    def positions(self, codes: np.ndarray, inside: np.ndarray | None = None, core: slice = slice(None)) -> np.ndarray:
        """Label probabilities (T, C, B) of every position of the core."""
        logits = self.labels[0] @ self.scan(codes, 0, inside)[core]
        logits += self.labels[1] @ self.scan(codes, 1, inside)[core]
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(documents, C): the mean of the positions' probabilities."""
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        # Texts lie behind each other, whole windows each, with room for the margins.
        room = windows * WINDOW + 2 * MARGIN
        start = np.cumsum(room) - room + MARGIN
        data = np.zeros(int(room.sum()), np.uint8)
        for t, s in zip(texts, start.tolist(), strict=True):
            data[s : s + len(t)] = np.frombuffer(t, np.uint8)
        at = start[owner] + (np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]) * WINDOW
        total = np.zeros((len(texts), len(self.languages)))
        step, core = np.arange(-MARGIN, WINDOW + MARGIN)[:, None], slice(MARGIN, MARGIN + WINDOW)
        for lo in range(0, len(owner), TOGETHER):
            own = owner[lo : lo + TOGETHER]
            place = at[lo : lo + TOGETHER] + step
            inside = (place >= start[own]) & (place < (start + sizes)[own])
            p = self.positions(data[place], inside.astype(np.float32), core)
            np.add.at(total, own, np.einsum("tcb,tb->bc", p, inside[core].astype(np.float32)))
        return total / np.maximum(sizes, 1)[:, None]


def fresh(languages: list[str], hidden: int, seed: int) -> BiGru:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    c = len(languages)
    return BiGru(
        languages,
        [draw(256, 3 * hidden, by=0.3) for _ in range(2)],
        [draw(3 * hidden, hidden, by=1 / np.sqrt(hidden)) for _ in range(2)],
        [draw(c, hidden, by=1 / np.sqrt(hidden)) for _ in range(2)],
        np.zeros((c, 1), np.float32),
    )


def _forward(net: BiGru, codes: np.ndarray, way: int) -> tuple[np.ndarray, ...]:
    """States before and after each step and the gates, for the backward pass."""
    h_n, (steps, width) = net.hidden, codes.shape
    before, gates, carried = np.zeros((steps, h_n, width), np.float32), np.empty((steps, 3 * h_n, width), np.float32), np.empty((steps, h_n, width), np.float32)
    after, h = np.empty((steps, h_n, width), np.float32), np.zeros((h_n, width), np.float32)
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        x, g = net.inputs[way][codes[t]].T, net.states[way] @ h
        before[t], carried[t] = h, g[2 * h_n :]
        gates[t, : 2 * h_n] = 1 / (1 + np.exp(-(g[: 2 * h_n] + x[: 2 * h_n])))
        gates[t, 2 * h_n :] = np.tanh(x[2 * h_n :] + gates[t, :h_n] * carried[t])
        z, n = gates[t, h_n : 2 * h_n], gates[t, 2 * h_n :]
        h = n + z * (h - n)
        after[t] = h
    return before, gates, carried, after


def _backward(net: BiGru, codes: np.ndarray, way: int, kept: tuple[np.ndarray, ...], d_after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the state matrix of one direction."""
    before, gates, carried, _ = kept
    h_n, (steps, width) = net.hidden, codes.shape
    d_x, d_u, d_h = np.empty((steps, 3 * h_n, width), np.float32), np.zeros_like(net.states[way]), np.zeros((h_n, width), np.float32)
    for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
        r, z, n = gates[t, :h_n], gates[t, h_n : 2 * h_n], gates[t, 2 * h_n :]
        d_h = d_h + d_after[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (before[t] - n) * z * (1 - z)
        d_r = d_n * carried[t] * r * (1 - r)
        d_x[t] = np.concatenate([d_r, d_z, d_n])
        d_g = np.concatenate([d_r, d_z, d_n * r])
        d_u += d_g @ before[t].T
        d_h = d_h * z + net.states[way].T @ d_g
    flat = d_x.transpose(0, 2, 1).reshape(-1, 3 * h_n)
    order = np.argsort(codes.ravel(), kind="stable")
    seen, start = np.unique(codes.ravel()[order], return_index=True)
    d_table = np.zeros_like(net.inputs[way])
    d_table[seen] = np.add.reduceat(flat[order], start, axis=0)
    return d_table, d_u


def gradients(net: BiGru, codes: np.ndarray, used: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the used positions, and its gradients in the order of params()."""
    kept = [_forward(net, codes, way) for way in (0, 1)]
    logits = net.labels[0] @ kept[0][3] + net.labels[1] @ kept[1][3] + net.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    weight = (np.arange(codes.shape[0])[:, None] < used).astype(np.float32) / max(1, int(used.sum()))
    each = np.arange(codes.shape[1])
    loss = float(-(np.log(p[:, label, each] + 1e-30) * weight).sum())
    p[:, label, each] -= 1
    p *= weight[:, None, :]
    d_labels = [np.einsum("tcb,thb->ch", p, kept[way][3], optimize=True) for way in (0, 1)]
    d_way = [_backward(net, codes, way, kept[way], net.labels[way].T @ p) for way in (0, 1)]
    return loss, [d_way[0][0], d_way[1][0], d_way[0][1], d_way[1][1], *d_labels, p.sum(axis=(0, 2))[:, None]]


def train(rows: list[tuple[str, str]], hidden: int = 12, steps: int = 260, width: int = 192, rate: float = 0.02, seed: int = 5) -> BiGru | None:
    """A network from (text window, language) rows; languages get equal shares of each step's windows."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    net = fresh(languages, hidden, seed)
    # A window of characters is one window of bytes or, of other letters than Latin ones, several.
    of = [[raw[i : i + WINDOW] for t, lang in rows if lang == x for raw in [t.encode("utf-8")] for i in range(0, max(1, len(raw)), WINDOW)] for x in languages]
    codes = [np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") for t in ts), np.uint8).reshape(-1, WINDOW) for ts in of]
    used = [np.array([len(t) for t in ts], np.int64) for ts in of]
    rng, params = np.random.default_rng(seed), net.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = max(1, width // len(languages))
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        pick = [rng.integers(0, len(c), share) for c in codes]
        x = np.ascontiguousarray(np.concatenate([c[i] for c, i in zip(codes, pick, strict=True)]).T)
        _, grads = gradients(net, x, np.concatenate([u[i] for u, i in zip(used, pick, strict=True)]), np.repeat(np.arange(len(languages)), share))
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):  # Adam with clipped gradients
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, sample_docs: int = 300, sample_windows: int = 3, spare: int = 4) -> list[tuple[str, str]]:
    """Windows of up to sample_docs documents of each language, the first by hash; places by hash too. Languages
    are counted first, so that only about spare times as many documents of each are sorted."""
    docs = docs.filter(F.col("lang").isNotNull())
    counts = docs.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), F.lit(float(spare * sample_docs)) / F.col("count")))
    shares = {r["lang"]: r["share"] for r in counts.collect()}
    if not shares:
        return []
    size, h = F.length("text"), F.xxhash64("doc_id", "text")
    at = lambda k: F.substring("text", F.lit(1) + F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(size - WINDOW, F.lit(1))).cast("int"), F.lit(WINDOW))
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    rows = docs.filter((F.pmod(h, F.lit(2**30)) < share * F.lit(2**30)) & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", h.alias("h"), F.array(*[at(k) for k in range(sample_windows)]).alias("parts"))
    first = Window.partitionBy("lang").orderBy("h", "parts")
    picked = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample_docs).collect()
    return sorted((p, r["lang"]) for r in picked for p in r["parts"] if p)


@lru_cache(maxsize=1)
def _one_thread() -> None:
    """BLAS threads would only compete with the executor's other tasks."""
    import ctypes
    import glob
    import os

    for lib in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        handle = ctypes.CDLL(lib)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(handle, name):
                getattr(handle, name)(1)
                return


def identify(docs: DataFrame, net: BiGru | None, keep: bool = False) -> DataFrame:
    """docs with lang_pred and score; without the text unless keep."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def start():
        _one_thread()
        model = sent.value

        def predict(texts: list) -> dict[str, list]:
            known = [i for i, t in enumerate(texts) if t and model is not None and any(map(str.isalpha, t))]
            name, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known:
                p = model.documents([texts[i].encode("utf-8") for i in known])
                for i, k, s in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    name[i], score[i] = model.languages[k], min(s, 1.0)
            return {"lang_pred": name, "score": score}

        return predict

    return from_texts(docs, {"lang_pred": "string", "score": "double"}, start, keep=keep)


def op10_langid_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    net = train(sample(docs.filter(~held_out)))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), net)
