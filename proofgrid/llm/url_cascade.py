"""URL filtering with exact Bloom filter cascades.

A list of host-and-path rules is encoded for the urls it will judge: level 0 holds the
listed keys; level 1 the keys of the corpus that level 0 wrongly accepts; level 2 the
listed keys that level 1 wrongly accepts, and so on until a level accepts nothing wrongly.
A key of the corpus is listed if and only if the first level that doesn't hold it is an
odd one, so membership is exact over the corpus's whole key universe and judging a url
needs no join. The first level's error rate is chosen from the sizes of list and universe
so that its false positives are about as many as the listed keys, and all later levels
are no larger than the list; only these are gathered on the driver.

The keys of a url are the ends of its host at a dot, with each number of labels that some
rule has, joined to the beginnings of its path with each length that some rule has. There
is a cascade for each verdict; the longest listed key wins (all keys of one url that tie in
length differ, and the host's longer end then goes first).

Defined results: null urls and urls without ``://`` have an empty host and path and, like
urls that no rule fits, the default verdict and no rule. Tables of rules may be empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, A-Z lower-cased; path) of a url, both empty where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def url_keys(host: Column, path: Column, rules: list[str]) -> Column:
    """All keys of a url that may equal a rule, the longest first."""
    depths = sorted({h.count(".") + 1 for h, _ in map(split_rule, rules)}, reverse=True)
    lengths = sorted({len(p) for _, p in map(split_rule, rules)}, reverse=True)
    labels = F.split(host, r"\.")
    keys = [
        F.when((F.size(labels) >= d) & (F.length(path) >= n), F.concat(F.array_join(F.slice(labels, -d, d), "."), path.substr(1, n)))
        for d in depths
        for n in lengths
    ]
    return F.array_sort(F.array_compact(F.array(*keys)), lambda a, b: F.length(b) - F.length(a)) if keys else F.array().cast("array<string>")


@dataclass
class Level:
    bits: np.ndarray
    hashes: int

    @classmethod
    def of(cls, keys: np.ndarray, rate: float, level: int) -> Level:
        n = max(1, len(keys))
        size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        made = cls(np.zeros(-(-size // 8) * 8, bool), max(1, round(-math.log2(rate))))
        for at in made._places(keys, level):
            made.bits[at] = True
        return made

    def _places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        k = keys.astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            a = (k ^ np.uint64(level * 0x9E3779B9 + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            a ^= a >> np.uint64(29)
            b = a * np.uint64(0x94D049BB133111EB) | np.uint64(1)
            for i in range(self.hashes):
                x = a + np.uint64(i) * b
                x ^= x >> np.uint64(32)
                yield (x % np.uint64(len(self.bits))).astype(np.int64)

    def holds(self, keys: np.ndarray, level: int) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys, level):
            out &= self.bits[at]
        return out


@dataclass
class Cascade:
    """Exact membership, over one universe of keys (64-bit hashes), in a list."""

    levels: list[Level] = field(default_factory=list)

    def listed(self, keys: np.ndarray) -> np.ndarray:
        answer = np.zeros(len(keys), bool)
        alive = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            alive = alive[level.holds(keys[alive], k)]
            answer[alive] = k % 2 == 0
        return answer


def build(listed: np.ndarray, universe: DataFrame, universe_size: int, key: str = "key", most: int = 50_000_000) -> Cascade:
    """The cascade of listed (hashes) over universe (a table with the hashes in column key).

    universe_size may count repeated keys; most bounds the false positives gathered, which
    are expected to be fewer than the listed keys.
    """
    if not len(listed):
        return Cascade()
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * len(listed) / max(1, universe_size)))
    cascade = Cascade([Level.of(listed, rate, 0)])
    known = np.sort(listed)
    first = universe.sparkSession.sparkContext.broadcast((cascade.levels[0], known))

    def wrong(batches: Iterator[pa.RecordBatch]):
        level, members = first.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.unique(keys[level.holds(keys, 0)])
            yield {"key": np.setdiff1d(keys, members, assume_unique=True)}

    found = map_arrow(universe.select(F.col(key).alias("key")), wrong, "key long").distinct().limit(most + 1).toPandas()["key"].to_numpy(np.int64)
    if len(found) > most:
        raise ValueError(f"level 0 has over {most} false positives; the list is too large for one cascade")
    inside, outside = found, known  # what the next level holds, and what it must not accept
    while len(inside):
        k = len(cascade.levels)
        level = Level.of(inside, 0.5, k)
        cascade.levels.append(level)
        inside, outside = outside[level.holds(outside, k)], inside
    return cascade


def judge(urls: DataFrame, rules: Mapping[str, str], default: str = "allow", url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep with host, path, rule (the longest that fits, or null) and verdict for every row of urls.

    rules maps a rule (host, then path from its slash) to its verdict.
    """
    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = urls.select(*(F.col(f"`{k}`") for k in keep), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__keys", url_keys(F.col("host"), F.col("path"), list(rules)))
    rows = rows.withColumn("__hashes", F.transform("__keys", lambda k: F.xxhash64(k)))
    spark = urls.sparkSession
    universe = rows.select(F.explode("__hashes").alias("key"))
    verdicts = sorted(set(rules.values()))
    hashed = {r["rule"]: r["h"] for r in spark.createDataFrame([(r,) for r in rules], "rule string").select("rule", F.xxhash64("rule").alias("h")).collect()} if rules else {}
    size = universe.count() if rules else 0
    cascades = {v: build(np.array([hashed[r] for r in rules if rules[r] == v], np.int64), universe, size) for v in verdicts}
    shared = spark.sparkContext.broadcast(cascades)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if not f.name.startswith("__")), "rule string", "verdict string"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hashes, keys = batch.column("__hashes"), batch.column("__keys")
            flat, starts = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), hashes.offsets.to_numpy()
            starts = starts - starts[0]
            texts = keys.flatten()
            rule, verdict = np.full(batch.num_rows, -1, np.int64), np.full(batch.num_rows, default, object)
            for name, cascade in shared.value.items():
                hit = np.flatnonzero(cascade.listed(flat))
                row = np.searchsorted(starts, hit, side="right") - 1
                for r, h in zip(row[::-1], hit[::-1]):  # backwards, so that a row's first and longest key stays
                    if rule[r] < 0 or h <= rule[r]:
                        rule[r], verdict[r] = h, name
            picked = texts.take(pa.array(rule, pa.int64(), mask=rule < 0))
            yield {n: batch.column(n) for n in batch.schema.names if not n.startswith("__")} | {"rule": picked, "verdict": pa.array(verdict.tolist(), pa.string())}

    return map_arrow(rows, run, schema)
