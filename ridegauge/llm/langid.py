"""Language ID by a small byte convolutional network.

Bytes are embedded, filters of several widths slide over windows of fixed length, each filter's maximum over the window is kept, and a
softmax over the languages follows. The network is trained in numpy with Adam on windows of a bounded sample: at most ``per_language``
documents of each language (chosen by a hash of the id), at most ``WINDOWS_A_TEXT`` windows spread over each. It has a fixed size and
travels with the tasks. A text is predicted from all of its windows: mean log probabilities, weighted by the bytes in a window.

Null texts and texts without a letter are ``und`` with score 0. Null languages are not learned. Repeated rows are predicted one by one;
further columns pass through. Without labelled rows every text is ``und``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ridegauge.llm.common import add_columns, id_remainder, raw, ready, table

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBEDDING = 6
PER_LANGUAGE = 600
WINDOWS_A_TEXT = 4
HELD_OUT_OF, HELD_OUT = 4, 2
BLOCK = 256
UNDETERMINED = "und"
_CANDIDATE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _CANDIDATE.finditer(text))


def windows_of(data: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text (the last one padded with zeros) and the bytes in each."""
    n = max(1, -(-len(data) // window))
    out = np.zeros(n * window, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    sizes = np.full(n, window)
    sizes[-1] = len(data) - (n - 1) * window
    return out.reshape(n, window), sizes


@dataclass
class Network:
    """``kernel`` holds all filters at the largest width; a narrower filter has zeros behind its own bytes."""

    languages: list[str]
    embedding: np.ndarray  # 256 x e
    kernel: np.ndarray  # (largest width x e) x filters
    bias: np.ndarray
    dense: np.ndarray  # filters x languages
    offset: np.ndarray

    def columns(self, x: np.ndarray) -> np.ndarray:
        """Embedded bytes of every position and those behind it, for windows x."""
        e, widest = self.embedding.shape[1], self.kernel.shape[0] // self.embedding.shape[1]
        padded = np.concatenate((x, np.zeros((len(x), widest - 1), np.uint8)), axis=1)
        flat = np.ascontiguousarray(self.embedding[padded])
        step = flat.strides
        view = np.lib.stride_tricks.as_strided(flat, (len(x), x.shape[1], widest * e), (step[0], step[1], step[2]))
        return view.reshape(len(x) * x.shape[1], widest * e)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return (self.columns(x) @ self.kernel).reshape(len(x), x.shape[1], -1).max(axis=1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float64)
        for at in range(0, len(x), BLOCK):
            part = np.maximum(self.pooled(x[at : at + BLOCK]) + self.bias, 0) @ self.dense + self.offset
            part = part.astype(np.float64)
            part -= part.max(axis=1, keepdims=True)
            out[at : at + BLOCK] = part - np.log(np.exp(part).sum(axis=1, keepdims=True))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if known:
            cut = [windows_of(raw(texts[i]).lower()) for i in known]
            logs = self.log_probabilities(np.concatenate([c[0] for c in cut]))
            weights = np.concatenate([c[1] for c in cut]).astype(float)
            starts = np.cumsum([0, *(len(c[0]) for c in cut[:-1])])
            mean = np.add.reduceat(logs * weights[:, None], starts) / np.add.reduceat(weights, starts)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, best, score in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                langs[i], scores[i] = self.languages[best], score
        return langs, scores


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """Train on windows ``x`` with language numbers ``y``."""
    rng = np.random.default_rng(seed)
    widest, e, total = max(WIDTHS), EMBEDDING, FILTERS * len(WIDTHS)
    mask = np.zeros((widest * e, total), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * e, i * FILTERS : (i + 1) * FILTERS] = 1
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, e)).astype(np.float32),
        (rng.normal(0, 0.4, mask.shape) * mask).astype(np.float32),
        np.zeros(total, np.float32),
        rng.normal(0, 0.3, (total, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    if len(languages) < 2 or not len(x):
        return net
    parameters = [net.embedding, net.kernel, net.bias, net.dense, net.offset]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb, yb, n = x[rows], y[rows], len(rows)
            columns = net.columns(xb)
            scores = (columns @ net.kernel).reshape(n, x.shape[1], total)
            where = scores.argmax(axis=1)
            top = np.take_along_axis(scores, where[:, None, :], axis=1)[:, 0]
            hidden = np.maximum(top + net.bias, 0)
            logits = hidden @ net.dense + net.offset
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p /= n
            back = (p @ net.dense.T) * (hidden > 0)
            best = columns.reshape(n, x.shape[1], -1)[np.arange(n)[:, None], where]  # n x filters x (width x e)
            by_byte = (net.kernel.T[None] * back[:, :, None]).reshape(n, total, widest, e)
            padded = np.concatenate((xb, np.zeros((n, widest - 1), np.uint8)), axis=1)
            octets = padded[np.arange(n)[:, None, None], where[:, :, None] + np.arange(widest)]
            to_embedding = np.stack([np.bincount(octets.ravel(), by_byte[..., d].ravel(), 256) for d in range(e)], axis=1)
            grads = [to_embedding, np.einsum("bfk,bf->kf", best, back) * mask, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            now = rate * (1 - epoch / epochs)
            for q, g, m, v in zip(parameters, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample of the training rows; the driver gets a count for each language and the sampled windows."""
    spark = ready(docs.sparkSession)
    learned = docs.select("doc_id", "lang", "text").filter((id_remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in learned.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    space = 1 << 30
    shares = spark.createDataFrame([(lang, int(min(1.0, per_language / n) * space)) for lang, n in counts.items()], "lang string, below bigint")
    chosen = learned.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < F.col("below"))  # one row a language

    def spread(texts):
        out = []
        for t in texts:
            cut, _ = windows_of(raw(t).lower())
            picks = np.unique(np.linspace(0, len(cut) - 1, WINDOWS_A_TEXT).astype(int))
            out.append([cut[i].tobytes() for i in picks.tolist()])
        return (out,)

    rows = add_columns(chosen.select("doc_id", "lang", "text"), "windows array<binary>", spread).select("doc_id", "lang", "windows").orderBy("doc_id", "lang", "windows")
    number = {lang: i for i, lang in enumerate(languages)}
    xs, ys = [], []
    for r in rows.limit(2 * per_language * len(languages)).collect():
        for w in r["windows"]:
            xs.append(np.frombuffer(bytes(w), np.uint8))
            ys.append(number[r["lang"]])
    return np.array(xs, np.uint8).reshape(-1, WINDOW), np.array(ys, int), languages


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network:
    return fit(*training_windows(docs, per_language))


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    ready(docs.sparkSession)
    net = network
    return add_columns(docs, "lang_pred string, score double", lambda texts: net.predict(texts))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = train(docs)
    held_out = (id_remainder(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT).alias("held_out")
    return identify(docs.select("doc_id", "text"), network).select("doc_id", held_out, "lang_pred", "score")
