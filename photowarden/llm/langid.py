"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of fixed length; byte embeddings pass through filters of several widths, each
filter's response is max-pooled over the window, and a softmax over the pooled responses gives the window's language.
A document's language is that of the length-weighted mean of its windows' log-probabilities; the score is the mean
probability of that language. The whole text is read.

Training uses a bounded sample of windows: about `per_language` of each language, drawn by a hash of id and place from
all windows of all its texts, so a long text counts with all its parts. Each epoch goes through the whole sample. The
languages are the classes of the network, MOST_LANGUAGES of them at most: the driver holds its weights and the sample.

Defined results: null text, or text without a letter (Unicode category L), is `und` with score 0; unlabelled documents are
only predicted; a training set without labels predicts `und` for all; very long texts are read whole; of languages that
are equally likely the first in order of name is taken; repeated rows have equal results; an empty table gives no rows;
extra columns are carried along unless they are named lang_pred or score, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photowarden.llm import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 16, 8
PER_LANGUAGE, MOST_LANGUAGES = 4000, 1000
#: Windows of the training sample, which the driver gets: 20 MB.
MOST_WINDOWS = 80_000
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.01, 7
#: Share of the training texts (windows, in the query) of which a short part is learned too.
SHORT = 0.1
#: Windows that are scored at once.
AT_ONCE = 256
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCnn:
    """Weights: byte embeddings, per width a filter bank (width * embed, filters), and the output layer."""

    languages: list[str]
    embed: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.banks, *self.biases, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray, argmax: bool = False):
        """Max-pooled responses (n, widths * filters), and with argmax their positions."""
        x = np.ascontiguousarray(self.embed[windows].transpose(0, 2, 1))
        n, e, length = x.shape
        parts, places = [], []
        for w, bank, bias in zip(WIDTHS, self.banks, self.biases, strict=True):
            steps = length - w + 1
            cols = np.empty((n, w * e, steps), np.float32)
            for j in range(w):
                cols[:, j * e : (j + 1) * e] = x[:, :, j : j + steps]
            response = np.matmul(bank.T, cols)
            if argmax:
                at = response.argmax(2)
                places.append(at)
                parts.append(np.take_along_axis(response, at[:, :, None], 2)[:, :, 0] + bias)
            else:
                parts.append(response.max(2) + bias)
        return (np.concatenate(parts, 1), places) if argmax else np.concatenate(parts, 1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(windows), AT_ONCE):
            logits = np.maximum(self.pooled(windows[a : a + AT_ONCE]), 0) @ self.out + self.out_bias
            logits -= logits.max(1, keepdims=True)
            out[a : a + AT_ONCE] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last padded with zeros, and their lengths."""
    n = max(1, -(-len(data) // WINDOW))
    buf = np.zeros(n * WINDOW, np.uint8)
    buf[: len(data)] = np.frombuffer(data, np.uint8)
    lengths = np.full(n, WINDOW)
    lengths[-1] = len(data) - (n - 1) * WINDOW
    return buf.reshape(n, WINDOW), lengths


def train(texts: list[str | bytes], labels: list[str], seed: int = SEED) -> ByteCnn | None:
    """Minibatch Adam on the cross entropy of all windows; languages count alike however many windows they have."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        data = common.utf8(text) if isinstance(text, str) else text
        if not _LETTER.search(data.decode("utf-8", "ignore")):
            continue
        w, _ = windows_of(data)
        xs.append(w)
        ys += [languages.index(label)] * len(w)
        if rng.random() < SHORT:  # a part of it, so that short texts are known too
            cut = int(rng.integers(8, 80))
            at = int(rng.integers(0, max(1, len(data) - cut + 1)))
            xs.append(windows_of(data[at : at + cut])[0])
            ys.append(languages.index(label))
    if not xs:
        return None
    x, y = np.concatenate(xs), np.array(ys)
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y]
    weight *= len(y) / weight.sum()
    scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    model = ByteCnn(
        languages, scale(256, EMBED) * 8, [scale(w * EMBED, FILTERS) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        scale(FILTERS * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32),
    )
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))  # all windows of the sample
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            step += 1
            _adam(model.parameters(), _gradients(model, x[rows], y[rows], weight[rows]), moments, step)
    return model


def _gradients(model: ByteCnn, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    pooled, places = model.pooled(x, argmax=True)
    hidden = np.maximum(pooled, 0)
    logits = hidden @ model.out + model.out_bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= (weight / len(y)).astype(np.float32)[:, None]
    d_hidden = (p @ model.out.T) * (pooled > 0)
    d_embed = np.zeros_like(model.embed)
    d_banks, d_biases = [], []
    rows = np.arange(len(x))[:, None]
    for k, w in enumerate(WIDTHS):
        d = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
        d_bank = np.empty_like(model.banks[k])
        for j in range(w):  # only the pooled position of a filter has a gradient
            seen = x[rows, places[k] + j]
            part = slice(j * EMBED, (j + 1) * EMBED)
            d_bank[part] = np.einsum("nf,nfe->ef", d, model.embed[seen])
            given = (d[:, :, None] * model.banks[k][part].T[None]).reshape(-1, EMBED)
            flat = seen.ravel()
            for c in range(EMBED):
                d_embed[:, c] += np.bincount(flat, given[:, c], 256)
        d_banks.append(d_bank)
        d_biases.append(d.sum(0))
    return [d_embed, *d_banks, *d_biases, hidden.T @ p, p.sum(0)]


def _adam(parameters, gradients, moments, step: int) -> None:
    for p, g, (m, v) in zip(parameters, gradients, moments, strict=True):
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """About per_language windows of each language and their languages, drawn from whole texts; fewer where so many
    languages would give more than MOST_WINDOWS. Of more than MOST_LANGUAGES labels the rarest, by windows, are no classes."""
    spark = docs.sparkSession
    data = F.col("text").cast("binary")
    labelled = docs.filter("lang is not null and text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("id"), data.alias("data"), "lang", F.ceil(F.octet_length("text") / WINDOW).cast("int").alias("n"))
    counts = labelled.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    per_language = min(per_language, MOST_WINDOWS // max(1, len(counts)))
    # one row a language, at most MOST_LANGUAGES: small enough to broadcast
    chances = F.broadcast(spark.createDataFrame([(r["lang"], per_language / r["n"]) for r in counts], "lang string, chance double"))
    lot = lambda i: F.pmod(F.xxhash64("key", i), F.lit(1_000_003)) / 1_000_003.0
    drawn = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: lot(i) < F.col("chance"))
    keyed = labelled.withColumn("key", F.xxhash64("id", "data")).join(chances, "lang")
    rows = keyed.select("lang", "id", "data", F.explode(drawn).alias("i"))
    rows = rows.select("lang", "id", "i", F.substring("data", F.col("i") * WINDOW + 1, F.lit(WINDOW)).alias("window")).select("lang", "id", "i", "window").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("lang", "id", "i", "window")])
    return rows["window"].to_pylist(), rows["lang"].to_pylist()


def predict_text(model: ByteCnn | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    und = [model is None or not t or not _LETTER.search(t) for t in texts]
    cut = [windows_of(common.utf8(t)) for t, u in zip(texts, und, strict=True) if not u]
    if not cut:
        return ["und"] * len(texts), [0.0] * len(texts)
    logs = np.empty((sum(len(w) for w, _ in cut), len(model.languages)), np.float32)
    at, pile, size = 0, [], 0
    for w, _ in cut:  # a few windows more than AT_ONCE at a time
        pile.append(w)
        size += len(w)
        if size >= AT_ONCE:
            logs[at : at + size] = model.log_probabilities(np.concatenate(pile))
            at, pile, size = at + size, [], 0
    if pile:
        logs[at : at + size] = model.log_probabilities(np.concatenate(pile))
    n = np.array([len(w) for w, _ in cut])
    weight = np.concatenate([k for _, k in cut]).astype(np.float64)
    first = np.cumsum(n) - n
    total = np.add.reduceat(weight, first)
    best = (np.add.reduceat(logs * weight[:, None], first) / total[:, None]).argmax(1)
    sure = (np.add.reduceat(np.exp(logs.astype(np.float64)) * weight[:, None], first) / total[:, None])[np.arange(len(n)), best]
    found = iter(zip(best.tolist(), np.clip(sure, 0, 1).tolist(), strict=True))
    langs, scores = [], []
    for u in und:
        b, s = (None, 0.0) if u else next(found)
        langs.append("und" if u else model.languages[b])
        scores.append(s)
    return langs, scores


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter, by the rule of predict_text; no model is needed."""
    common.prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in common.slices(batches):
            yield batch.filter(pa.array([bool(t and _LETTER.search(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """Adds lang_pred and score; only the text is read for them."""
    common.prepare(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = own.index("text")

    def run(batches):
        for batch in common.slices(batches):
            langs, scores = predict_text(model, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*own, "lang_pred", "score"])

    rows = docs.select(*(F.col(f"`{c}`") for c in own))
    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", lang_pred string, score double")
