"""A byte-level convolutional network for page quality, in numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import page_texts, text_of
from tallywork.session import write_scratch

register_pickle_by_value(sys.modules[__name__])

WIDTH = 8  # bytes under a filter
STRIDE = 4  # half a filter: neighbouring chunks overlap, and every byte lies under some chunk
CHANNELS = 8  # seven learned ones for each byte, one for repetition
FILTERS = 24
LOOK_BACK = 40
BYTES_AT_ONCE = 1 << 18


def repetition(raw: np.ndarray) -> np.ndarray:
    """1 for each byte that begins eight bytes which also stand up to LOOK_BACK bytes before, 0 elsewhere."""
    out = np.zeros(raw.size, "float32")
    if raw.size > WIDTH:
        eights = np.zeros(raw.size - 7, "uint64")
        for i in range(8):
            eights |= raw[i:raw.size - 7 + i].astype("uint64") << np.uint64(8 * i)
        for back in range(2, min(LOOK_BACK, eights.size - 1) + 1):
            out[back:eights.size][eights[back:] == eights[:-back]] = 1
    return out


@dataclass
class Network:
    """Bytes to channels, filters over overlapping chunks, the largest answer of each filter, one weighted sum."""

    embedding: np.ndarray  # 256 x (CHANNELS - 1)
    filters: np.ndarray  # (WIDTH * CHANNELS) x FILTERS
    filter_bias: np.ndarray
    weights: np.ndarray  # FILTERS + 1: the last for the logarithm of the length
    bias: float

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.5, (256, CHANNELS - 1)).astype("float32"),
            rng.normal(0, (2 / (WIDTH * CHANNELS)) ** 0.5, (WIDTH * CHANNELS, FILTERS)).astype("float32"),
            np.zeros(FILTERS, "float32"), rng.normal(0, 0.1, FILTERS + 1).astype("float32"), 0.0)

    def chunks(self, raw: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """The chunks of a text, a row each, the end filled up with zero channels."""
        count = max(0, -(-(raw.size - WIDTH) // STRIDE)) + 1
        channels = np.zeros(((count - 1) * STRIDE + WIDTH, CHANNELS), "float32")
        channels[:raw.size, :-1] = self.embedding[raw]
        channels[:raw.size, -1] = repeated
        flat = channels.ravel()
        step = flat.itemsize
        return np.lib.stride_tricks.as_strided(
            flat, (count, WIDTH * CHANNELS), (STRIDE * CHANNELS * step, step), writeable=False)

    def pooled(self, raw: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of each filter over the whole text, and the chunk that gave it."""
        best, where = np.zeros(FILTERS, "float32"), np.full(FILTERS, -1)
        last = max(0, -(-(raw.size - WIDTH) // STRIDE))
        for first in range(0, last + 1, BYTES_AT_ONCE // STRIDE):
            begin = first * STRIDE
            part = slice(begin, begin + BYTES_AT_ONCE + WIDTH - STRIDE)
            answers = self.chunks(raw[part], repeated[part]) @ self.filters
            answers += self.filter_bias
            at = answers.argmax(axis=0)
            top = answers[at, np.arange(FILTERS)]
            better = top > best  # an answer below 0 counts as 0, of no chunk
            best[better], where[better] = top[better], first + at[better]
        return best, where

    def features(self, raw: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, where = self.pooled(raw, repeated)
        return np.append(best, np.float32(np.log1p(raw.size) / 10)), where

    def score(self, text: str) -> float:
        """The probability that the whole text is good."""
        raw = np.frombuffer(text.encode(), "uint8")
        x, _ = self.features(raw, repetition(raw))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30))))


def gradient(
    net: Network, raws: list[np.ndarray], repeats: list[np.ndarray], y: np.ndarray, weight: np.ndarray
) -> tuple[dict[str, np.ndarray], float]:
    """The gradient of the texts' weighted log loss by the network's arrays and its bias."""
    grads = {n: np.zeros_like(getattr(net, n)) for n in ("embedding", "filters", "filter_bias", "weights")}
    grad_bias = 0.0
    for raw, repeated, label, share in zip(raws, repeats, y, weight, strict=True):
        x, where = net.features(raw, repeated)
        z = float(np.clip(x @ net.weights + net.bias, -30, 30))
        error = float((1 / (1 + np.exp(-z)) - label) * share)
        grads["weights"] += error * x
        grad_bias += error
        for k in np.flatnonzero(where >= 0):
            delta, begin = error * net.weights[k], where[k] * STRIDE
            seen = raw[begin:begin + WIDTH]
            window = np.zeros((WIDTH, CHANNELS), "float32")
            window[:seen.size, :-1] = net.embedding[seen]
            window[:seen.size, -1] = repeated[begin:begin + WIDTH]
            grads["filters"][:, k] += delta * window.ravel()
            grads["filter_bias"][k] += delta
            back = delta * net.filters[:, k].reshape(WIDTH, CHANNELS)[:seen.size, :-1]
            np.add.at(grads["embedding"], seen, back)
    return grads, grad_bias


def fit(texts: list[str], labels: list[int], rounds: int = 12, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Network:
    """A network fitted to whole texts by Adam, one batch of 16 texts at a time, both labels weighing the same.

    Only the chunk that gives a filter's largest answer gets its gradient, so a step back costs a few chunks a text.
    With one label only, or none, the network says that label's share (a half without any) for every text.
    """
    net, y = Network.fresh(seed), np.array(labels, "float32")
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()) if y.size else 0.5, 1e-3), 1 - 1e-3)
        net.weights[:], net.bias = 0, float(np.log(share / (1 - share)))
        return net
    raws = [np.frombuffer(t.encode(), "uint8") for t in texts]
    repeats = [repetition(r) for r in raws]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    names = ("embedding", "filters", "filter_bias", "weights")
    state = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names}
    bias_state, step, rng = [0.0, 0.0], 0, np.random.default_rng(seed + 1)
    batch = 16
    total = rounds * -(-len(raws) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(raws))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            grads, grad_bias = gradient(net, [raws[i] for i in some], [repeats[i] for i in some], y[some], balance[some] / len(some))
            step += 1
            now = rate * (1 - step / (total + 1))
            for n in names:
                value, (m, v) = getattr(net, n), state[n]
                g = grads[n] + decay * value
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            bias_state[0] += 0.1 * (grad_bias - bias_state[0])
            bias_state[1] += 0.001 * (grad_bias ** 2 - bias_state[1])
            net.bias -= now * (bias_state[0] / (1 - 0.9 ** step)) / ((bias_state[1] / (1 - 0.999 ** step)) ** 0.5 + 1e-8)
    return net


def fit_quality(pages: DataFrame, labels: DataFrame, rows_a_label: int = 1000, bytes_a_label: int = 1 << 25, seed: int = 0) -> Network:
    """The network for ``pages(page_id, html)`` and ``labels(page_id, quality)``, quality being 0 or 1.

    Fitted on a bounded sample, on the driver: of each label, apart, up to ``rows_a_label`` labelled pages, whole texts of together
    up to ``bytes_a_label`` bytes, in the order of a hash of page_id and text; a text that no longer fits is passed over.
    Labels of other values, or missing, aren't used, nor pages without an id; a page with contradictory labels counts
    for both. Repeated rows count once, pages of one id and different texts each. Without pages or labels
    the network knows no more than :func:`fit` says. Nothing but the text goes into the network.
    """
    texts = page_texts(pages).filter("page_id IS NOT NULL")
    known = labels.filter("quality IN (0, 1)").select(F.col("page_id").alias("label_id"), F.col("quality").cast("int").alias("quality")).distinct()
    first = [F.xxhash64("label_id", F.lit(seed)), F.col("label_id")]
    named = known.filter("quality = 1").orderBy(*first).limit(rows_a_label).unionByName(
        known.filter("quality = 0").orderBy(*first).limit(rows_a_label))  # bounded: rows of two columns
    digest = F.sha2("html", 256)
    places = write_scratch(texts.join(F.broadcast(named), F.col("page_id") == F.col("label_id")).select(
        "page_id", "quality", F.xxhash64("page_id", "html", F.lit(seed)).alias("draw"), digest.alias("digest"),
        F.octet_length("html").alias("bytes")).distinct(), "labelled")
    chosen = []
    for label in (0, 1):
        left = bytes_a_label
        for r in places.filter(F.col("quality") == label).orderBy("draw", "page_id", "digest").limit(rows_a_label).collect():
            if r["bytes"] <= left:
                chosen.append((r["page_id"], label, r["digest"]))
                left -= r["bytes"]
    sample: list[tuple[str, int]] = []
    if chosen:
        kind = pages.schema["page_id"].dataType.simpleString()
        wanted = pages.sparkSession.createDataFrame(chosen, f"label_id {kind}, quality int, digest string")
        rows = texts.join(F.broadcast(wanted), (F.col("page_id") == F.col("label_id")) & (digest == F.col("digest"))).dropDuplicates(
            ["page_id", "quality", "digest"]).orderBy("quality", *first, "digest").collect()
        sample = [(r["html"], r["quality"]) for r in rows]
    return fit([html for html, _ in sample], [label for _, label in sample], seed=seed)


def score_column(html: Column, network: Network) -> Column:
    """The chance that the whole text is good; missing and empty texts get the score of an empty text.

    Equal texts get equal scores, in every row in which they stand; a table without rows gives none. Further columns stay as
    they are. Very long texts are read in pieces of BYTES_AT_ONCE. The network (some thousand numbers) travels with the tasks; rows stay where they are.
    """
    parts = network.embedding, network.filters, network.filter_bias, network.weights, network.bias

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        here = Network(*parts)
        for texts in batches:
            yield pd.Series([here.score(t) for t in texts], dtype="float64")

    return score(text_of(html))


def score_pages(pages: DataFrame, network: Network) -> DataFrame:
    """(page_id, score) for each row of ``pages(page_id, html)``, repeated rows included, by :func:`score_column`."""
    return pages.select("page_id", score_column(F.col("html"), network).alias("score"))
