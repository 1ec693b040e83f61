"""The sample that the line field is fitted on."""

import itertools

import numpy as np

from sentrail.llm import crf


def test_one_row_of_each_sampled_id(spark, monkeypatch):
    """An id in many rows sends one of them to the driver."""
    free = [k for k, f in spark.range(100).select("id", crf.fold_of("id", crf.FOLDS)).collect() if f != crf.HELD_OUT]
    hot, other = free[:2]
    docs = spark.createDataFrame([(hot, f"text {k} of one id") for k in range(20)] + [(other, "another text"), (other, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(hot, 1), (other, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(crf, "fit", lambda x, first, y: seen.append((sorted(y.tolist()), len(first) - 1)))
    crf.train(docs, labels)
    assert seen == [([0, 1], 2)]


def plain(node, edge, first):
    """Marginals and log partition by all labellings."""
    out, logz = [], 0.0
    for a, b in zip(first[:-1], first[1:], strict=True):
        weights = {}
        for y in itertools.product((0, 1), repeat=int(b - a)):
            weights[y] = np.exp(sum(node[a + k] * v for k, v in enumerate(y)) + sum(edge[u, v] for u, v in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        logz += np.log(z) if b > a else 0
        out += [sum(w for y, w in weights.items() if y[k]) / z for k in range(b - a)]
    return np.array(out), logz


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 3, 4, 9])
    node, edge = rng.normal(size=9) * 3, rng.normal(size=(2, 2))
    good, pair, logz = crf._marginals(node, edge, first)
    want, want_z = plain(node, edge, first)
    assert np.allclose(good, want) and np.isclose(logz, want_z)
    step = 1e-6
    for u in range(2):
        for v in range(2):
            moved = edge.copy()
            moved[u, v] += step
            assert np.isclose((plain(node, moved, first)[1] - want_z) / step, pair[u, v], atol=1e-4)


def test_fit_is_a_maximum():
    """At the fitted weights, no small step of any weight raises the penalised likelihood by much."""
    rng = np.random.default_rng(3)
    first = np.array([0, 4, 9, 10, 14])
    x, y = rng.normal(size=(14, crf.N_FEATURES)), np.array([1, 0, 1, 0])
    field = crf.fit(x, first, y, steps=2000, rate=0.03, ridge=1e-2)
    data = crf._with_neighbours((x - field.mean) / field.std, first)
    label = np.repeat(y, np.diff(first))

    def loss(theta):
        weight, edge = theta[:-4], theta[-4:].reshape(2, 2)
        node = data @ weight
        got = (node * label).sum() + sum(edge[label[k - 1], label[k]] for k in range(1, 14) if k not in first)
        return (plain(node, edge, first)[1] - got) / 14 + 0.5 * 1e-2 * (theta**2).sum()

    theta = np.concatenate([field.weight, field.edge.ravel()])
    at = loss(theta)
    for k in range(len(theta)):
        moved = theta.copy()
        moved[k] += 1e-4
        assert abs(loss(moved) - at) < 2e-6


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = crf.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(bad) > 10 and auc > 0.98


def test_long_texts_and_one_class(spark):
    """A text of many lines counts whole; labels of one class alone give scores of that side."""
    docs = spark.createDataFrame([(k, "a fine line of words here\n" * (20_000 if k == 1 else 3)) for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(12)], "doc_id long, quality int")
    got = crf.classify(docs, labels).collect()
    assert len(got) == 12 and all(r.score > 0.5 for r in got)
    assert crf.classify(docs, labels, most_lines=10).count() == 12
