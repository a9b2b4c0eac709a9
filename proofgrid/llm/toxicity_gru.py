"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is a sequence of words (cut at white space, lower-cased, stripped of what isn't a
letter or digit at the ends; longer ones in pieces). A word's input has two parts: an own
vector if the word is frequent enough in the sample, else one shared by all others, and
the mean of vectors of its hashed character n-grams (of UTF-8 bytes, ends marked). Two
gated recurrent layers read each window of ``WINDOW`` words, one in each direction;
attention weights their states, and the weighted mean gives the window's score. Windows
overlap, every word is in at least one, and a text scores as its highest window.

The network is trained in numpy, on the driver, on a bounded sample of labelled rows:
``positives`` and ``negatives`` rows by a hash of the id, of at most ``LONGEST_FITTED``
characters each (longer texts are scored like all others, but not fitted). As labels are
those of texts, each step takes the highest window of a text, and for clean texts another
one as well. Scoring runs in Arrow batches over all windows of all texts; what a worker
keeps of words is bounded.

Defined results: a null text, and one without words, scores like an empty window. If there
are no rows of both labels to fit, all texts score the share of label 1, (n1 + 0.5) /
(n + 1). A null label takes no part; of several labels of an id the highest holds. Each row
gives a row, repeated ids and rows included; equal texts have equal scores, up to single
precision. Columns of docs named like the result's are replaced, others pass through. No
row gives no row.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

#: Words of a window, and from one window to the next.
WINDOW, STEP = 48, 32
#: Sizes of a word's own vector, of its characters' vector, and of each direction's state; most words with an own vector.
OWN, CHARS, STATE, WORDS = 8, 6, 8, 30_000
#: Bytes of n-grams, and how many hashed ones there are.
SIZES, GRAMS = (3, 6), 1 << 15
#: Characters of a word; longer ones are cut.
LONGEST = 32
#: Words that a worker keeps before it starts afresh; windows that are scored at once; words of texts that are read at once.
KEEP, BATCH, BLOCK = 400_000, 2048, 1 << 19
#: Characters of a text that can be in the sample.
LONGEST_FITTED = 40_000
#: Rounds over the sample, more if it is so small that there are fewer than STEPS steps; texts of a step.
EPOCHS, STEPS, MOST_EPOCHS, RATE, GROUP = 5, 200, 40, 0.01, 64


def words_of(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return words


def bare(word: str) -> str:
    """A word without what isn't a letter or digit at its ends, unless it is nothing else."""
    if word.isalnum():
        return word
    k, n = 0, len(word)
    while k < n and not word[k].isalnum():
        k += 1
    while n > k and not word[n - 1].isalnum():
        n -= 1
    return word[k:n] or word


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, word by word, and where each word's begin."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"\x02" + b"\x03\x02".join(raw) + b"\x03" + bytes(max(SIZES)), np.uint8).astype(np.uint64)
    size = np.array([*map(len, raw)], np.int64) + 2
    starts = np.cumsum(size) - size
    count = np.stack([np.maximum(size - n + 1, n == SIZES[0]) for n in SIZES])  # a shorter word has no larger n-grams
    out, at = np.empty(int(count.sum()), np.int64), np.cumsum(count.sum(axis=0)) - count.sum(axis=0)
    before = np.zeros_like(at)
    for n, own in zip(SIZES, count):
        code = np.zeros(len(data) - max(SIZES), np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | data[k : k + len(code)]
        hashed = ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(49)).astype(np.int64)
        within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(at + before, own) + within] = hashed[np.repeat(starts, own) + within]
        before = before + own
    return out, at


def windows_of(n: int) -> list[int]:
    """First words of the windows of n words: steps, and one that ends with the last word."""
    return [*range(0, n - WINDOW, STEP), n - WINDOW] if n > WINDOW else [0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights: word and n-gram vectors; input, state and bias weights of both directions; attention and output."""

    words: dict[str, int]
    p: dict[str, np.ndarray] = field(repr=False)
    prior: float | None = None
    scorer: Scorer | None = field(default=None, repr=False)

    @classmethod
    def fresh(cls, words: dict[str, int], lean: np.ndarray, gram_lean: np.ndarray, seed: int = 0) -> Network:
        """lean, gram_lean: how far words and n-grams lean to label 1, for the first place of their vectors."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * shape[-1] ** -0.5 * 0.5).astype(np.float64)
        p = {"own": draw(len(words) + 1, OWN), "gram": draw(GRAMS, CHARS), "w": draw(2, OWN + CHARS, 3 * STATE), "u": draw(2, STATE, 3 * STATE), "b": np.zeros((2, 3 * STATE)), "a": draw(2 * STATE), "o": draw(2 * STATE), "c": np.zeros(1)}
        p["own"][:, 0], p["gram"][:, 0] = np.r_[0, lean], gram_lean
        return cls(words, p)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of bare words, and what their gradient needs."""
        at, starts = ngrams(words)
        own = np.array([self.words.get(w, -1) for w in words]) + 1
        count = np.diff(np.r_[starts, len(at)])[:, None]
        gram = np.add.reduceat(self.p["gram"][at], starts, axis=0) / count
        return np.concatenate([self.p["own"][own], gram], axis=1), (own, at, starts, count)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the gates of each direction get from inputs."""
        return np.stack([x @ self.p["w"][d] + self.p["b"][d] for d in (0, 1)])

    @staticmethod
    def padding() -> np.ndarray:
        """What gates get where there is no word: the state stays."""
        return np.r_[np.full(STATE, 30.0), np.zeros(2 * STATE)]

    def gates(self, words: list[str]) -> np.ndarray:
        """Gates' inputs of no word, and of each of the bare words."""
        x = self.project(self.inputs(words)[0])
        return np.concatenate([np.tile(self.padding(), (2, 1, 1)), x], axis=1)

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows, rows of ids into gates (0: no word)."""
        n, length = ids.shape
        states = np.empty((2, length, n, STATE), gates.dtype)
        saved: list = []
        turned = np.ascontiguousarray(ids.T)
        for d in (0, 1):
            u = self.p["u"][d].astype(gates.dtype)
            h = np.zeros((n, STATE), gates.dtype)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                x, s = gates[d].take(turned[t], axis=0), h @ u
                zr = _sigmoid(x[:, : 2 * STATE] + s[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                new = np.tanh(x[:, 2 * STATE :] + r * s[:, 2 * STATE :])
                if keep:
                    saved.append((d, t, h, z, r, new, s[:, 2 * STATE :]))
                h = new + z * (h - new)
                states[d, t] = h
        hidden = np.concatenate([states[0], states[1]], axis=2)
        score = hidden @ self.p["a"].astype(gates.dtype) + np.where(ids.T == 0, np.float32(-1e4), np.float32(0))
        weight = np.exp(score - score.max(axis=0))
        weight *= (ids.T != 0)
        weight /= np.maximum(weight.sum(axis=0), 1e-30)
        pooled = np.einsum("tn,tnk->nk", weight, hidden)
        return pooled @ self.p["o"].astype(gates.dtype) + self.p["c"][0], (saved, hidden, weight, pooled)

    def gradient(self, words: list[str], ids: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Logits, and the gradient of the sum of what wrong(logits) derives, for windows of ids (0: none) into words."""
        x, (own, at, starts, count) = self.inputs(words)
        gates = np.concatenate([np.tile(self.padding(), (2, 1, 1)), self.project(x)], axis=1)
        logits, (saved, hidden, weight, pooled) = self.forward(gates, ids, keep=True)
        err = wrong(logits)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["c"][0], g["o"] = err.sum(), pooled.T @ err
        dpool = err[:, None] * self.p["o"]
        dweight = np.einsum("tnk,nk->tn", hidden, dpool)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["a"] = np.einsum("tn,tnk->k", dscore, hidden)
        dhidden = weight[:, :, None] * dpool + dscore[:, :, None] * self.p["a"]
        dgates, back = np.zeros_like(gates), np.zeros((len(ids), STATE))
        direction = 1
        for d, t, h, z, r, new, sn in reversed(saved):
            if d != direction:
                direction, back = d, np.zeros((len(ids), STATE))
            back = back + dhidden[t, :, STATE * d : STATE * (d + 1)]
            dnew = back * (1 - z) * (1 - new * new)
            dz, dr = back * (h - new) * z * (1 - z), dnew * sn * r * (1 - r)
            ds = np.concatenate([dz, dr, dnew * r], axis=1)
            g["u"][d] += h.T @ ds
            np.add.at(dgates[d], ids[:, t], np.concatenate([dz, dr, dnew], axis=1))
            back = back * z + ds @ self.p["u"][d].T
        dx = np.zeros_like(x)
        for d in (0, 1):
            part = dgates[d, 1:]
            g["w"][d], g["b"][d] = x.T @ part, part.sum(axis=0)
            dx += part @ self.p["w"][d].T
        np.add.at(g["own"], own, dx[:, :OWN])
        np.add.at(g["gram"], at, np.repeat(dx[:, OWN:] / count, count[:, 0], axis=0))
        return logits, g


def _indexed(texts: list[list[str]]) -> tuple[list[str], list[np.ndarray]]:
    """Bare words of all texts, each once, and each text as numbers of them (from 1)."""
    number: dict[str, int] = {}
    return number, [np.array([number.setdefault(bare(w), len(number) + 1) for w in t], np.int64) for t in texts]  # type: ignore[return-value]


def _cut(ids: np.ndarray) -> np.ndarray:
    """A text's windows, rows of WINDOW numbers; 0 where there is no word."""
    padded = np.r_[ids, np.zeros(max(0, WINDOW - len(ids)), ids.dtype)]
    return np.stack([padded[k : k + WINDOW] for k in windows_of(len(ids))])


def train(texts: list[list[str]], labels: np.ndarray, seed: int = 0) -> Network:
    """A network fitted to words of texts and their labels."""
    epochs = max(EPOCHS, min(MOST_EPOCHS, STEPS * GROUP // len(texts)))
    rng = np.random.default_rng(seed)
    number, ids = _indexed(texts)
    names, sizes = [*number], [max(1, int((labels == y).sum())) for y in (0, 1)]
    grams, starts = ngrams(names)
    ends = np.r_[starts[1:], len(grams)]
    seen, gram_seen = np.zeros((2, len(names) + 1)), np.zeros((2, GRAMS))
    for t, y in zip(ids, labels):
        own = np.unique(t)
        seen[int(y), own] += 1
        gram_seen[int(y), np.unique(np.concatenate([grams[starts[w - 1] : ends[w - 1]] for w in own] or [grams[:0]]))] += 1
    lean = lambda n: np.clip(np.log((n[1] + 0.5) / (sizes[1] + 1)) - np.log((n[0] + 0.5) / (sizes[0] + 1)), -3, 3) / 3
    common = sorted(np.flatnonzero(seen.sum(axis=0) >= 3).tolist(), key=lambda w: (-seen[:, w].sum(), names[w - 1]))[:WORDS]
    net = Network.fresh({names[w - 1]: k for k, w in enumerate(common)}, lean(seen)[common], np.where(gram_seen.sum(axis=0) >= 3, lean(gram_seen), 0), seed)
    cuts = [_cut(t) for t in ids]
    first = np.cumsum([0, *map(len, cuts)])
    rows = np.concatenate(cuts)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        gates = net.gates(names).astype(np.float32)
        logits = np.concatenate([net.forward(gates, rows[k : k + BATCH])[0] for k in range(0, len(rows), BATCH)])
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), GROUP):
            group = order[lo : lo + GROUP]
            top = [first[i] + int(logits[first[i] : first[i + 1]].argmax()) for i in group]
            other = [int(rng.integers(first[i], first[i + 1])) for i in group if labels[i] == 0]
            y = np.r_[labels[group], np.zeros(len(other))]
            some, ids_ = np.unique(rows[top + other], return_inverse=True)
            ids_ = ids_.reshape(-1, WINDOW)
            if some[0] == 0:
                some = some[1:]
            else:
                ids_ = ids_ + 1
            if not len(some):
                continue
            _, g = net.gradient([names[k - 1] for k in some], ids_, lambda x, y=y: (_sigmoid(x) - y) / GROUP)
            step += 1
            for k, v in net.p.items():
                m = moment[k]
                m[0] = 0.9 * m[0] + 0.1 * g[k]
                m[1] = 0.999 * m[1] + 0.001 * g[k] ** 2
                v -= RATE * (1 - epoch / epochs) * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return net


class Scorer:
    """Scores texts with a network; keeps what gates get from the words met, up to a bound."""

    def __init__(self, net: Network, keep: int = KEEP):
        self.net, self.keep = net, keep
        self._reset(0)

    def _reset(self, room: int) -> None:
        self.rows: dict[str, int] = {}
        self.gates = np.zeros((2, self.keep + room + 1, 3 * STATE), np.float32)
        self.gates[:, 0] = self.net.padding()

    def _number(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(new) >= self.gates.shape[1]:
            new = [*dict.fromkeys(words)]
            self._reset(len(new))
            rows = self.rows
        if new:
            start = len(rows) + 1
            for k in range(0, len(new), 50_000):
                part = new[k : k + 50_000]
                self.gates[:, start + k : start + k + len(part)] = self.net.project(self.net.inputs([*map(bare, part)])[0])
            rows.update(zip(new, range(start, start + len(new))))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """The highest window's score of each text."""
        out = np.full(len(texts), float(_sigmoid(self.net.p["c"][0])))
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return out
        ids = np.r_[self._number([*chain.from_iterable(texts[k] for k in full)]), np.zeros(WINDOW, np.int64)]
        size = np.array([len(texts[k]) for k in full])
        begins = np.cumsum(size) - size
        starts = [windows_of(n) for n in size]
        owner = np.repeat(np.arange(len(full)), [*map(len, starts)])
        first = np.fromiter(chain.from_iterable(starts), np.int64) + begins[owner]
        end = (begins + size)[owner]
        best = np.full(len(full), -np.inf)
        for k in range(0, len(first), BATCH):
            at = first[k : k + BATCH, None] + np.arange(WINDOW)
            rows = np.where(at < end[k : k + BATCH, None], ids[np.minimum(at, len(ids) - 1)], 0)
            np.maximum.at(best, owner[k : k + BATCH], self.net.forward(self.gates, rows)[0])
        out[full] = _sigmoid(np.clip(best, -60, 60))
        return out


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = 1000, negatives: int = 2000) -> Network:
    """A network from labelled rows where train_rows, a condition on the id, holds."""
    known = labels.select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`").cast("int").alias("label")).where(train_rows & F.col(f"`{id_col}`").isNotNull() & F.col("label").isNotNull())
    known = known.groupBy(id_col).agg((F.max("label") > 0).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(12)), F.lit(1 << 30))
    share = lambda n, label: min(1 << 30, (n << 30) // max(1, sizes.get(label, 0)) + 1)
    bound = F.when(F.col("label") == 1, share(positives, 1)).otherwise(share(negatives, 0))
    chosen = known.where(draw < bound).limit(2 * (positives + negatives))  # far beyond what is expected
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") <= LONGEST_FITTED)
    got = rows.join(F.broadcast(chosen), id_col).select(F.col(id_col).cast("string").alias("id"), "text", "label").limit(4 * (positives + negatives)).collect()
    got = sorted({r["text"]: r for r in sorted(got, key=lambda r: (r["text"], -r["label"]), reverse=True)}.values(), key=lambda r: (r["id"], r["text"]))
    y = np.array([r["label"] for r in got])
    if len(set(y.tolist())) < 2:
        return Network({}, {}, (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1))
    return train([words_of(r["text"]) for r in got], y)


def score(docs: DataFrame, net: Network, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 from least on)."""
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    keep = [f for f in docs.schema if f.name not in {a.name for a in added}]
    names = [f.name for f in keep]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]):
        net = shared.value
        if net.scorer is None and net.prior is None:  # the next tasks of this worker go on with it
            net.scorer = Scorer(net)
        scorer = net.scorer
        for batch in batches:
            texts = batch.column("__text")
            lo, size, block = 0, 0, []
            for k in range(batch.num_rows):
                block.append(words_of(texts[k].as_py()) if scorer else [])
                size += len(block[-1]) + 1
                if size >= BLOCK or k + 1 == batch.num_rows:
                    gc.disable()  # a block makes many small values and no cycles
                    got = scorer.score(block) if scorer else np.full(len(block), net.prior)
                    gc.enable()
                    yield {n: batch.column(n).slice(lo, len(block)) for n in names} | {"score": got, "predicted": (got >= least).astype(np.int32)}
                    lo, size, block = k + 1, 0, []

    rows = docs.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text_col}`").alias("__text"))
    return map_arrow(rows, run, T.StructType(keep + added))
