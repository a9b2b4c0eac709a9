"""The network's gradient, its windows against a plain loop, hostile tables, held-out accuracy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from proofgrid.llm import toxicity_gru as gru
from proofgrid.llm.common import fold_of

LABELS = "doc_id long, toxic int"


def network(words=("mild", "calm", "rude"), seed=3):
    rng = np.random.default_rng(seed)
    return gru.Network.fresh({w: k for k, w in enumerate(words)}, rng.standard_normal(len(words)), np.zeros(gru.GRAMS), seed)


def test_gradient():
    net, words = network(), ["mild", "rude", "unseen", "a"]
    ids = np.array([[1, 2, 3, 4, 2], [3, 1, 0, 0, 0]])
    sign = np.array([1.0, -2.0])
    _, g = net.gradient(words, ids, lambda x: sign)
    total = lambda: float(net.forward(net.gates(words), ids)[0] @ sign)
    rng = np.random.default_rng(0)
    for name, v in net.p.items():
        live = np.argwhere(np.abs(g[name]) > 1e-9) if name in ("own", "gram") else np.argwhere(np.ones_like(v))
        for at in map(tuple, rng.permutation(live)[:12]):
            was = v[at]
            v[at] = was + 1e-6
            up = total()
            v[at] = was - 1e-6
            down = total()
            v[at] = was
            assert abs((up - down) / 2e-6 - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), name


def test_windows():
    for n in (0, 1, gru.WINDOW - 1, gru.WINDOW, gru.WINDOW + 1, 1000):
        starts = gru.windows_of(n)
        assert {k for s in starts for k in range(s, min(n, s + gru.WINDOW))} == set(range(n)) and len(set(starts)) == len(starts)
    assert gru.words_of(None) == [] and gru.words_of("Ab, " + "x" * 70) == ["ab,", "x" * 32, "x" * 32, "x" * 6]
    assert [*map(gru.bare, ["(ab,", "a", "!!", "é-é."])] == ["ab", "a", "!!", "é-é"]


def plain(net, words):
    """A text's score, one word and one window after the other."""
    s, p = gru.STATE, net.p
    sig = lambda x: 1 / (1 + np.exp(-x))
    best = []
    for start in gru.windows_of(len(words)):
        win = words[start : start + gru.WINDOW]
        if not win:
            return float(sig(p["c"][0]))
        x = net.inputs([*map(gru.bare, win)])[0]
        states = np.zeros((len(win), 2 * s))
        for d, order in ((0, range(len(win))), (1, range(len(win) - 1, -1, -1))):
            h = np.zeros(s)
            for t in order:
                a, b = x[t] @ p["w"][d] + p["b"][d], h @ p["u"][d]
                z, r = sig(a[:s] + b[:s]), sig(a[s : 2 * s] + b[s : 2 * s])
                h = z * h + (1 - z) * np.tanh(a[2 * s :] + r * b[2 * s :])
                states[t, s * d : s * (d + 1)] = h
        w = np.exp(states @ p["a"])
        best.append(sig((w / w.sum()) @ states @ p["o"] + p["c"][0]))
    return float(max(best))


def test_scores_are_those_of_a_plain_loop():
    net = network()
    rng = np.random.default_rng(1)
    texts = [[], ["rude"], *([str(w) for w in rng.choice(["mild", "calm", "rude,", "other", "wörter", "!!"], n)] for n in (5, 47, 48, 49, 130, 700))]
    want = [plain(net, t) for t in texts]
    for keep in (400, 3):  # a table of words that is begun afresh all the time as well
        scorer = gru.Scorer(net, keep)
        assert np.allclose(scorer.score(texts), want, atol=1e-5)
        assert np.allclose([scorer.score([t])[0] for t in texts], want, atol=1e-5)


def corpus(spark, n=400):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choice(words, rng.integers(3, 300)).tolist()
        if bad := i % 4 == 0:
            text[rng.integers(len(text))] = f"{rng.choice(['grub', 'dolt'])}{'!' if i % 3 else ''}"
        rows.append((i, " ".join(text), "clash", "clash", "clash"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string, label string"), spark.createDataFrame(labels, LABELS)


def test_fit_and_held_out(spark):
    docs, labels = corpus(spark)
    net = gru.fit(docs, labels, fold_of("doc_id", 5) != 0)
    got = {r["doc_id"]: r for r in gru.score(docs, net).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 400 and len(held) > 50
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 and r["label"] == "clash" for r in got.values())
    hostile = [None, "", "  ", "!!", "GRUB", "w1 " * 20_000 + "dolt " + "w2 " * 20_000, "é" * 50_000, "w1 w2", "w1 w2"]
    table = spark.createDataFrame([(i if i < 8 else 7, t) for i, t in enumerate(hostile)], "doc_id long, text string").withColumn("__text2", F.lit(1))
    rows = sorted(gru.score(table.repartition(3), net).collect(), key=lambda r: r["doc_id"])
    assert len(rows) == 9 and rows[0]["score"] == rows[1]["score"] == rows[2]["score"]
    assert rows[4]["predicted"] == rows[5]["predicted"] == 1 and rows[7]["predicted"] == rows[8]["predicted"] == 0 and abs(rows[7]["score"] - rows[8]["score"]) < 1e-6
    assert gru.score(table.limit(0), net).count() == 0
    again = gru.fit(docs.repartition(7), labels.repartition(3), fold_of("doc_id", 5) != 0)
    assert all(np.array_equal(net.p[k], again.p[k]) for k in net.p)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rows, want in (([], 0.5), ([(1, 0), (2, 0), (2, None), (None, 1)], 0.5 / 3), ([(1, 1)], 0.75)):
        net = gru.fit(docs, spark.createDataFrame(rows, LABELS), F.lit(True))
        assert [round(r["score"], 9) for r in gru.score(docs, net).collect()] == [round(want, 9)] * 2
