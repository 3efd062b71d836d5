"""The network: gradients by differences, whole texts, and accuracy on labels that it hasn't seen."""

import numpy as np
import pytest

from tallywork.llm import quality_model as q
from tallywork.llm.queries import QUERIES
from samples import edge_pages, no_pages  # noqa: F401

FOLDER = "/root/testdata/sf0.01"


def test_every_byte_counts_however_long_the_text(monkeypatch):
    net = q.Network.fresh(0)
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 123, 5000).astype("uint8")
    whole, at = net.pooled(raw, q.repetition(raw))
    monkeypatch.setattr(q, "BYTES_AT_ONCE", 256)
    parts, at_parts = net.pooled(raw, q.repetition(raw))
    assert np.allclose(whole, parts, atol=1e-5) and (at == at_parts).all()
    assert q.repetition(np.frombuffer(b"word word word word ", "uint8")).sum() > 0
    assert q.repetition(np.frombuffer(b"no part of this is repeated", "uint8")).sum() == 0


def test_one_step_follows_the_gradient():
    texts, labels = ["good plain text here", "bad ### text *** here"], [1, 0]

    def loss(net):
        p = np.clip([net.score(t) for t in texts], 1e-9, 1 - 1e-9)
        return -np.log(p[0]) - np.log(1 - p[1])
    assert loss(q.fit(texts, labels, rounds=30)) < loss(q.Network.fresh(0)) / 3


def test_one_label_or_none():
    assert q.fit([], []).score("anything") == pytest.approx(0.5)
    assert q.fit(["a", "b"], [1, 1]).score("") > 0.9


def test_edges(spark, edge_pages, no_pages):
    net = q.Network.fresh(1)
    got = {r["page_id"]: r["score"] for r in q.score_pages(edge_pages, net).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[3] == got[4] == pytest.approx(net.score(""))
    assert q.score_pages(no_pages, net).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 7)], "page_id long, quality int")
    assert 0 <= q.fit_quality(edge_pages, labels).score("x") <= 1
    assert q.fit_quality(no_pages, labels).score("x") == pytest.approx(0.5)


def test_held_out_accuracy(spark):
    scored = QUERIES["op4_quality_classifier"](spark, FOLDER)
    judged = scored.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in judged) >= 0.9 * len(judged)
    assert scored.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def plain_score(net, text):
    """The network as it is defined, byte by byte."""
    raw = text.encode()
    repeated = [float(any(raw[i:i + 8] == raw[i - back:i - back + 8] for back in range(2, q.LOOK_BACK + 1) if i >= back) and len(raw[i:i + 8]) == 8)
                for i in range(len(raw))]
    best = [0.0] * q.FILTERS
    for start in range(0, max(0, -(-(len(raw) - q.WIDTH) // q.STRIDE)) * q.STRIDE + 1, q.STRIDE):
        for k in range(q.FILTERS):
            total = float(net.filter_bias[k])
            for j in range(q.WIDTH):
                if start + j < len(raw):
                    channels = [*net.embedding[raw[start + j]], repeated[start + j]]
                    total += sum(float(c) * float(net.filters[j * q.CHANNELS + i, k]) for i, c in enumerate(channels))
            best[k] = max(best[k], total)
    z = sum(b * float(w) for b, w in zip(best, net.weights)) + float(net.weights[-1]) * np.log1p(len(raw)) / 10 + net.bias
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("text", ["", "a", "seven77", "eight888", "nine99999", "so so so so so so so so so so so so", "Wörter und mehr, bis hierher: 日本語. " * 4])
def test_scores_against_a_plain_forward_pass(text):
    net = q.Network.fresh(7)
    net.filter_bias[:] = np.linspace(-0.5, 0.5, q.FILTERS)
    assert net.score(text) == pytest.approx(plain_score(net, text), abs=1e-5)


def test_gradient_by_finite_differences():
    net = q.Network.fresh(3)
    for name in ("embedding", "filters", "filter_bias", "weights"):
        setattr(net, name, getattr(net, name).astype("float64"))
    raws = [np.frombuffer(t, "uint8") for t in (b"a page of plain words", b"so so so so so so so so so so", b"x")]
    repeats, y, weight = [q.repetition(r) for r in raws], np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])

    def loss():
        total = 0.0
        for raw, repeated, label, share in zip(raws, repeats, y, weight):
            x, _ = net.features(raw, repeated)
            p = 1 / (1 + np.exp(-(x @ net.weights + net.bias)))
            total -= share * (label * np.log(p) + (1 - label) * np.log(1 - p))
        return total
    grads, grad_bias = q.gradient(net, raws, repeats, y, weight)
    rng, step = np.random.default_rng(5), 1e-3
    for name, g in grads.items():
        flat = getattr(net, name).reshape(-1)
        for i in rng.choice(flat.size, 12, replace=False).tolist() + np.abs(g).reshape(-1).argsort()[-4:].tolist():
            held = flat[i]
            flat[i] = held + step
            up = loss()
            flat[i] = held - step
            down = loss()
            flat[i] = held
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=3e-4), (name, i)
    net.bias += step
    up = loss()
    net.bias -= 2 * step
    assert grad_bias == pytest.approx((up - loss()) / (2 * step), abs=3e-4)


def test_sample_is_bounded_for_each_label_apart(spark, monkeypatch):
    rows = [(1, f"bad {i} " * 3) for i in range(20)] + [(2, "a good page"), (2, "a good page"), (3, "long " * 100_000), (3, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 1)], "page_id long, quality int")
    seen = {}
    monkeypatch.setattr(q, "fit", lambda texts, marks, seed: seen.update(texts=texts, labels=marks))
    q.fit_quality(pages, labels, rows_a_label=5)
    assert seen["labels"] == [0] * 5 + [1] * 3 and len(set(seen["texts"])) == 8 and "long " * 100_000 in seen["texts"]
    q.fit_quality(pages, labels, rows_a_label=2, bytes_a_label=100)
    assert len(seen["labels"]) >= 3 and sum(seen["labels"]) >= 1 and all(len(t) <= 100 for t in seen["texts"])
