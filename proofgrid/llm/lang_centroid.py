"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text becomes counts of byte n-grams (one to three bytes of its lower-cased letters,
other characters folded into one blank), hashed into a fixed number of features, damped
by a logarithm, weighted by inverse document frequency and normalised. Each language has
several centroids (spherical k-means of its training vectors); a text gets the language
of the centroid with the largest cosine. Texts farther from it than the rejection distance
are marked as rejected. As short texts share few n-grams with any centroid, each language
has a distance for each size of text (distinct n-grams, by powers of two), set from the
cosines of its fitted rows of that size and above.

The classifier is fitted on a bounded sample: of each language, the training rows whose
hashed id falls under a bound that lets about ``sample`` (a parameter) rows through.
Prediction reads every row and its whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0 and
rejected, as is everything when there is no labelled training row; equal cosines go to
the language that sorts first. Extra columns pass through; the columns added replace any
of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

FEATURES = 4096
#: Sizes of texts by the power of two of their distinct n-grams.
SIZES = FEATURES.bit_length()
UNKNOWN = "und"
#: Bytes that count as the blank between words: all ASCII but a-z.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def ngram_counts(text: str | None) -> np.ndarray:
    """Hashed counts of the 1- to 3-byte n-grams of a whole text."""
    raw = _FOLD[np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]].astype(np.uint32)
    two = raw[:-1] << 8 | raw[1:]
    three = two[:-1] << 8 | raw[2:]
    total = np.zeros(FEATURES, np.int64)
    for k, grams in enumerate((raw, two, three), 1):
        at = (grams + np.uint32(k << 24)) * np.uint32(2654435761) >> np.uint32(20)
        total += np.bincount(at.astype(np.int64), minlength=FEATURES)
    return total


@dataclass
class CentroidModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        x = np.empty((len(texts), FEATURES), np.float32)
        for i, t in enumerate(texts):
            x[i] = ngram_counts(t)
        np.log1p(x, out=x)
        x *= self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the index of its language, the cosine and whether it is rejected."""
        x = self.vectors(texts)
        cosines = x @ self.centroids.T
        best = cosines.argmax(axis=1)  # the first among equals; centroids are in the languages' order
        at, score = self.owner[best], np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
        return at, score, score < self.floors[at, _sizes(x)]


def _sizes(x: np.ndarray) -> np.ndarray:
    """The power of two of each row's distinct n-grams."""
    return np.log2(np.maximum((x > 0).sum(axis=1), 1)).astype(int)


def _floors(cosines: np.ndarray, sizes: np.ndarray, owner: np.ndarray, languages: int, quantile: float, margin: float, least: float) -> np.ndarray:
    """The smallest cosine that isn't rejected, by language and size of text.

    It is margin times a low quantile of the language's rows of that size, and no more than
    that of larger ones. Where it has too few rows for the quantile, all languages' rows
    count as well; sizes below all rows fall with the root of the size.
    """
    low = lambda c: float(np.quantile(c, quantile, method="lower")) if len(c) else np.inf
    out = np.full((languages, SIZES), np.inf)
    for n in range(languages):
        for k in range(SIZES):
            own = cosines[(owner == n) & (sizes == k)]
            out[n, k] = low(own) if len(own) * quantile >= 1 else min(low(own), low(cosines[sizes == k]))
        out[n] = np.minimum.accumulate(out[n, ::-1])[::-1]
        known = np.flatnonzero(np.isfinite(out[n]))
        out[n, known[-1] :] = out[n, known[-1]]
        first = int(sizes.min())
        out[n, :first] = out[n, first] * 2.0 ** (-(first - np.arange(first)) / 2)
    return np.maximum(margin * out, least)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, begun with the rows farthest from those chosen."""
    mean = x.mean(axis=0)
    seeds = [mean / max(np.linalg.norm(mean), 1e-12)]
    for _ in range(min(k, len(x)) - 1):
        seeds.append(x[int((x @ np.array(seeds).T).max(axis=1).argmin())])
    c = np.array(seeds)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", centroids: int = 4, sample: int = 600, floor: float = 0.05, quantile: float = 0.005, margin: float = 0.45) -> CentroidModel | None:
    """A model from the rows where train holds and the language isn't null; None if there are none.

    sample bounds the rows of each language that are expected to be used, centroids the
    centroids of each language. The smallest cosine that isn't rejected is margin times the
    quantile of the rows used, by language and size, and floor at least.
    """
    rows = docs.where(train & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").rlike(r"\p{L}"))
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in docs.where(train & F.col(f"`{lang_col}`").isNotNull()).groupBy(F.col(f"`{lang_col}`").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(17)), F.lit(1 << 30))
    bound = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1 << 30, (sample << 30) // n + 1))))
    chosen = rows.where(draw < bound[F.col("lang")])

    def counted(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts = [ngram_counts(t.as_py()) for t in part.column("text")]
                yield {"id": [str(i.as_py()) for i in part.column("id")], "lang": part.column("lang"), "at": [np.flatnonzero(c).astype(np.int16).tobytes() for c in counts], "n": [c[c > 0].astype(np.int32).tobytes() for c in counts]}

    got = sorted(map_arrow(chosen, counted, "id string, lang string, at binary, n binary").collect(), key=lambda r: (r["lang"], r["id"], bytes(r["at"]), bytes(r["n"])))
    if not got:
        return None
    x = np.zeros((len(got), FEATURES), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["n"], np.int32)
    langs = np.array([r["lang"] for r in got])
    names = sorted(set(langs.tolist()))
    # each language counts alike, whatever its share
    seen = np.mean([(x[langs == n] > 0).mean(axis=0) for n in names], axis=0)
    idf = (np.log(1.02 / (seen + 0.02)) + 0.05).astype(np.float32)
    np.log1p(x, out=x)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    groups = [_kmeans(x[langs == n], centroids) for n in names]
    owner = np.searchsorted(names, langs)
    own = np.empty(len(x))
    for k, g in enumerate(groups):
        own[owner == k] = (x[owner == k] @ g.T).max(axis=1)
    floors = _floors(own, _sizes(x), owner, len(names), quantile, margin, floor)
    return CentroidModel(names, idf, np.concatenate(groups).astype(np.float32), np.repeat(np.arange(len(names)), [len(g) for g in groups]), floors)


def identify(docs: DataFrame, model: CentroidModel | None, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    keep = [f for f in docs.schema if f.name not in {a.name for a in added}]
    names = [f.name for f in keep]
    rows = docs.select(*(F.col(f"`{n}`") for n in names), F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                letters = part.column("__letters").to_pylist()
                at, score, far = m.predict(part.column(text_col).to_pylist()) if m else (np.zeros(len(letters), int), np.zeros(len(letters)), np.ones(len(letters), bool))
                ok = [bool(m) and x for x in letters]
                yield {n: part.column(n) for n in names} | {
                    "lang_pred": [m.languages[a] if x else UNKNOWN for a, x in zip(at, ok)],
                    "score": [float(s) if x else 0.0 for s, x in zip(score, ok)],
                    "rejected": [not x or bool(f) for f, x in zip(far, ok)],
                }

    return map_arrow(rows, run, T.StructType(keep + added))
