"""Exact nearest names at scale: searches whose bounds prove that nothing better was missed.

Queries of up to 63 characters that no condition limits meet all entries, block by block. The
longest common subsequence of two texts, by bit vectors over all queries of a block at once,
rules most pairs out, as two entries at least as near are known; the distances of the others are computed.

For the other queries: two texts at edit distance d of at most D share, if one of them is cut into D + 1 segments,
at least one segment, and within the other text that segment can only have been moved by as
many places as there are edits left or right of it. So the segments of all entries, keyed by
length, D, place and text, and the few substrings of a query that can match them meet in an
equality join. A round of the search at a similarity finds all entries that are at least
that similar. A query with two such entries is done, as no entry it hasn't met can beat or
equal its second best; the others go on to a lower similarity. What is then left meets the
entries whose length alone doesn't rule them out.

Texts that contain each other are found by the rarest 5-gram of the inner one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import boundary_aligned, similarity
from ..storage import discard, stage

#: Characters that a contained text has at least (a fixed value of the similarity), and so of grams.
GRAM = 5
#: Percent of similarity of the rounds. Below, segments get so short that they meet more pairs than lengths do; at 50 they may be empty.
ROUNDS = (85, 75)
#: Entries that give a query which is still open a first bound; tasks that share the entries of a length.
SEEDS, PARTS = 256, 16
#: How tables of keys and of pairs are joined: Spark takes a text's many keys for no larger than the text, and would send them all through the driver to broadcast them.
SHUFFLED = "merge"
#: Characters of a query whose distances are computed by bit vectors; queries and entries of a block; one of so many blocks of entries gives first bounds.
BITS, BLOCK, FIRST = 63, 16384, 8
#: Entries whose common subsequences are looked at together, pairs measured at once, bytes of the subsequences on the way to an entry.
LOOK, PAIRS, TILE_BYTES = 1024, 1 << 17, 64 << 20


def _span(lo: Column, hi: Column) -> Column:
    """The whole numbers from lo to hi, none if lo is larger."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct substrings of a size."""
    return F.array_distinct(F.transform(_span(F.lit(1), F.length(text) - size + 1), lambda p: F.substr(text, p, F.lit(size))))


def containing(inner: DataFrame, outer: DataFrame, inner_text: str, outer_text: str) -> DataFrame:
    """Pairs of rows, all columns of both (whose names differ), where the outer text contains the inner one of GRAM characters or more.

    Each inner text is posted once, under the one of its grams that the fewest outer texts
    have; each outer text looks up its distinct grams. The pairs verified for an inner text
    are therefore no more than the outer texts that have its rarest gram.
    """
    posted = inner.where(F.length(inner_text) >= GRAM)
    look = outer.withColumn("_gram", F.explode(grams(F.col(outer_text))))
    counts = look.groupBy("_gram").agg(F.count("*").alias("_n"))
    texts = posted.select(F.col(inner_text).alias("_text")).distinct().withColumn("_gram", F.explode(grams(F.col("_text"))))
    # a gram that no outer text has rules the inner text out
    rarest = texts.join(counts.hint(SHUFFLED), "_gram", "left").groupBy("_text").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r")).where("_r.n > 0")
    keyed = posted.join(rarest.select("_text", F.col("_r._gram").alias("_gram")).hint(SHUFFLED), F.col(inner_text) == F.col("_text")).drop("_text")
    return look.join(keyed.hint(SHUFFLED), "_gram").where(F.col(outer_text).contains(F.col(inner_text))).drop("_gram")


def _edits(longer: Column, percent: int) -> Column:
    """Most edits of texts, the longer of which has that length, at the similarity or above."""
    return F.floor(longer * (100 - percent) / 100 + 1e-9).cast("int")


def _segment(n: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of edits + 1; the last ones are longer by one where n doesn't divide."""
    base, more = F.floor(n / (edits + 1)).cast("int"), n % (edits + 1)
    over = i - (edits + 1 - more)
    return i * base + F.greatest(F.lit(0), over), base + F.when(over >= 0, 1).otherwise(0)


def near(queries: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """(qid, eid): all pairs of (qid, query) and (eid, norm) at edit distance of at most 100 - percent percent of the longer text, each once."""
    if percent <= 50:
        raise ValueError("segments may be empty at a similarity of 50 percent or less")
    key = lambda n, d, i, text: F.xxhash64(n, d, i, text)  # noqa: E731  equal hashes of unequal keys only add pairs to verify
    n = F.length("norm")
    plans = _span(_edits(n, percent), _edits(F.floor(n * 100 / percent).cast("int"), percent))
    cut = lambda d, i: key(F.length("norm"), d, i, F.substr(F.col("norm"), _segment(n, d, i)[0] + 1, _segment(n, d, i)[1]))
    posted = entries.select("eid", "norm", F.explode(F.flatten(F.transform(plans, lambda d: F.transform(F.sequence(F.lit(0), d), lambda i: cut(d, i))))).alias("_key"))

    m = F.length("query")

    def places(size: Column, d: Column, i: Column) -> Column:
        """Keys of the query's substrings that can match segment i of a text of that size."""
        (start, width), ahead = _segment(size, d, i), m - size
        lo = F.greatest(F.lit(0), start - i, start + ahead - (d - i))
        hi = F.least(m - width, start + i, start + ahead + (d - i))
        return F.transform(_span(lo, hi), lambda p: key(size, d, i, F.substr(F.col("query"), p + 1, width)))

    def of_size(size: Column) -> Column:
        # F.transform over one value computes it once
        return F.flatten(F.transform(F.array(_edits(F.greatest(m, size), percent)), lambda d: F.flatten(F.transform(F.sequence(F.lit(0), d), lambda i: places(size, d, i)))))

    sizes = _span(F.ceil(m * percent / 100 - 1e-9).cast("int"), F.floor(m * 100 / percent + 1e-9).cast("int"))
    asked = queries.where(m > 0).select("qid", "query", F.explode(F.array_distinct(F.flatten(F.transform(sizes, of_size)))).alias("_key"))
    met = asked.join(posted.where(n > 0).hint(SHUFFLED), "_key")
    most = _edits(F.greatest(m, n), percent)
    return met.where((F.abs(m - n) <= most) & (F.levenshtein("query", "norm") <= most)).select("qid", "eid").distinct()


def _distances(masks: np.ndarray, m: np.ndarray, codes: np.ndarray, n: np.ndarray, query: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Edit distances of pairs, all at once by bit vectors: masks (letter, query), codes (place, entry), m and n the lengths."""
    order = np.argsort(-n[entry], kind="stable")
    query, entry = query[order], entry[order]
    word, flat, width = masks.dtype.type, masks.ravel(), masks.shape[1]
    one, last, left = word(1), (m[query] - 1).astype(word), n[entry]
    plus, minus, far = np.full(len(query), np.iinfo(word).max, word), np.zeros(len(query), word), m[query].astype(np.int32)
    for at, size in enumerate(np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")):  # pairs whose entry is longer than each place
        eq, p, q, end = flat.take(codes[at].take(entry[:size]) * width + query[:size]), plus[:size], minus[:size], last[:size]
        across = (((eq & p) + p) ^ p) | eq
        up, down = q | ~(across | p), p & across
        far[:size] += ((up >> end) & one).astype(np.int32) - ((down >> end) & one).astype(np.int32)
        up, eq = (up << one) | one, eq | q
        plus[:size], minus[:size] = (down << one) | ~(eq | up), up & eq
    out = np.empty_like(far)
    out[order] = far
    return out


class _Two:
    """The two largest values seen of each query."""

    def __init__(self, n: int) -> None:
        self.best = np.full((2, n), -1.0)

    def add(self, query: np.ndarray, value: np.ndarray) -> None:
        order = np.lexsort((-value, query))
        query, value = query[order], value[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.array([], np.intp)
        second = first[(first + 1 < len(query)) & (query[np.minimum(first + 1, len(query) - 1)] == query[first])] + 1 if len(query) else first
        for rows in (first, second):
            q, v = query[rows], value[rows]
            high, low = self.best[:, q]
            self.best[:, q] = np.maximum(high, v), np.maximum(low, np.minimum(high, v))


def _nearest_in_block(queries: list[str], entries: list[str], least: np.ndarray | None = None, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, similarity by edit distance, bound): for each query the entries that may be among its two best or tie with them.

    bound is a similarity that two entries have at least, here or, as least says, elsewhere. Where
    the distance is the difference in length one text may contain the other and so be worth a tenth
    less. Not whole: only a bound, one row for each query, from the entries that look nearest.

    The longest common subsequence of a query and an entry, which costs far less than a distance and is
    computed for all queries at once along the letters of the sorted entries (a beginning that
    entries share once), rules out most pairs: a distance is at least the longer length less it.
    """
    order = np.array(sorted(range(len(entries)), key=entries.__getitem__))
    n = np.fromiter((len(entries[i]) for i in order), np.int64, len(entries))
    text = lambda xs: np.frombuffer("".join(xs).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, letter = np.unique(text(entries[i] for i in order), return_inverse=True)
    row = np.repeat(np.arange(len(n)), n)
    codes = np.full((int(n.max()), len(n)), -1, np.int32)
    codes[np.arange(len(letter)) - np.repeat(np.cumsum(n) - n, n), row] = letter
    shared = np.minimum(n, np.r_[0, np.logical_and.accumulate(codes[:, 1:] == codes[:, :-1]).sum(axis=0)])
    paths = [codes[k:size, i].tolist() for i, (k, size) in enumerate(zip(shared.tolist(), n.tolist()))]
    every = np.fromiter(map(len, queries), np.int64, len(queries))
    least = np.full(len(queries), -1.0) if least is None else least
    tile = int(max(256, min(BLOCK, TILE_BYTES // (8 * len(codes)))))
    out = []
    for word, fits in ((np.uint32, every < 32), (np.uint64, every >= 32)):
        chosen = np.flatnonzero(fits)
        for own in (chosen[i : i + tile] for i in range(0, len(chosen), tile)):
            m = every[own]
            masks, asked = np.zeros((len(letters), len(own)), word), text(queries[i] for i in own)
            who, place = np.repeat(np.arange(len(own)), m), np.arange(len(asked)) - np.repeat(np.cumsum(m) - m, m)
            code = np.minimum(np.searchsorted(letters, asked), len(letters) - 1)
            for at in range(int(m.max())):
                here = (place == at) & (letters[code] == asked)
                masks[code[here], who[here]] |= word(1 << at)
            i, j, alike, bound = _nearest_in_tile(masks, m, codes, n, shared, paths, least[own], whole)
            out.append((own[i], order[j], alike, bound))
    return tuple(map(np.concatenate, zip(*out)))


def _nearest_in_tile(masks: np.ndarray, m: np.ndarray, codes: np.ndarray, n: np.ndarray, shared: np.ndarray, paths: list[list[int]], least: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_nearest_in_block for queries as masks and sorted entries as codes, of which each follows its path from what it shares with the one before."""
    word, count, bits = masks.dtype.type, len(m), masks.dtype.itemsize * 8
    full = [np.full(count, np.iinfo(word).max, word)]
    both, rows = np.empty(count, word), np.empty((LOOK, count), np.uint8)
    picked, exact, bound, limits = _Two(count), _Two(count), least.copy(), {}
    blind = not whole or bool((least < 0).any())
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def measured(query: np.ndarray, entry: np.ndarray, two: _Two) -> np.ndarray:
        far, size = _distances(masks, m, codes, n, query, entry), np.maximum(m[query], n[entry])
        alike = 1 - far / size
        two.add(query, np.where(far == np.abs(m[query] - n[entry]), 0.9 * alike, alike))
        np.maximum(bound, two.best[1], out=bound)
        limits.clear()
        return alike

    def settle() -> None:
        query, entry = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        alike = measured(query, entry, exact)
        good = alike >= bound[query] - 1e-6
        kept.append((query[good], entry[good], alike[good]))

    def limit(size: int) -> np.ndarray:
        """Most bits that an entry of a size which may be good enough leaves of each query."""
        longer = np.maximum(m, size)
        return np.clip(bits - longer + np.floor((1 - bound + 1e-6) * longer), 0, bits).astype(np.uint8)

    for start in range(0, len(n), LOOK):
        end = min(start + LOOK, len(n))
        for k in range(start, end):
            depth = int(shared[k])
            for code in paths[k]:
                if depth + 1 == len(full):
                    full.append(np.empty(count, word))
                was, now = full[depth], full[depth + 1]
                np.bitwise_and(was, masks[code], out=both)
                np.add(was, both, out=now)
                np.subtract(was, both, out=both)
                np.bitwise_or(now, both, out=now)
                depth += 1
            np.bitwise_count(full[depth], out=rows[k - start])
        half = (start + end) // 2
        for lo, hi in ((start, half), (half, end)):
            if lo < hi and blind:  # the entry with the longest subsequence gives a bound before anything is ruled out
                measured(np.arange(count), rows[lo - start : hi - start].argmin(axis=0) + lo, picked)
        if not whole:
            continue
        held = 0
        for k in range(start, end):
            size = int(n[k])
            if size not in limits:
                limits[size] = limit(size)
            hit = np.flatnonzero(rows[k - start] <= limits[size])
            if len(hit):
                waiting.append((hit, np.full(len(hit), k)))
                held += len(hit)
                if held >= PAIRS:
                    settle()
                    held = 0
        if waiting:
            settle()
    if not whole:
        return np.arange(count), np.zeros(count, np.intp), bound, bound
    query, entry, alike = (np.concatenate(x) for x in zip(*kept)) if kept else (np.array([], np.intp), np.array([], np.intp), np.array([]))
    good = alike >= bound[query] - 1e-6
    return query[good], entry[good], alike[good], bound[query[good]]


def nearest_of_all(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, eid): every (qid, query) of up to BITS characters with each (eid, norm) that may be among its two best by edit distance, ties included.

    Both sides are dealt into blocks, and each block of queries meets each block of entries in a
    task; before that it meets FIRST of the blocks of entries only for a bound, so that all blocks rule out more.
    """
    parts = [max(1, -(-df.count() // BLOCK)) for df in (queries, entries)]
    kinds = [dict(queries.dtypes)["qid"], dict(entries.dtypes)["eid"]]

    dealt = lambda df, key, n, own, other, m: df.withColumns({own: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})

    def met(asked: DataFrame, most: int, whole: bool) -> DataFrame:
        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            q, e = a.column("qid").combine_chunks(), b.column("eid").combine_chunks()
            if not len(q) or not len(e):
                return pa.table({"qid": q[:0], "eid": e[:0], "alike": pa.array([], pa.float64()), "bound": pa.array([], pa.float64())})
            i, j, alike, bound = _nearest_in_block(a.column("query").to_pylist(), b.column("norm").to_pylist(), a.column("bound").to_numpy(), whole)
            return pa.table({"qid": q.take(pa.array(i)), "eid": e.take(pa.array(j)), "alike": alike, "bound": bound})

        # more partitions than pairs of blocks: these are few and take long, and several may hash to one
        n = min(4 * parts[0] * most, max(1000, parts[0] * most))
        left = dealt(asked, "qid", parts[0], "_q", "_e", most).repartition(n, "_q", "_e")
        right = dealt(entries.select("eid", "norm"), "eid", parts[1], "_e", "_q", parts[0]).where(F.col("_e") < most).repartition(n, "_q", "_e")
        return left.groupBy("_q", "_e").cogroup(right.groupBy("_q", "_e")).applyInArrow(run, f"qid {kinds[0]}, eid {kinds[1]}, alike double, bound double")

    asked, first = queries.select("qid", "query").withColumn("bound", F.lit(-1.0)), -(-parts[1] // FIRST)
    if first < parts[1]:
        bounds = met(asked, first, False).groupBy("qid").agg(F.max("bound").alias("bound"))
        asked = stage(queries.select("qid", "query").join(bounds.hint(SHUFFLED), "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0))), "bounds")
    close = stage(met(asked, parts[1], True), "near in blocks")
    best = close.groupBy("qid").agg(F.max("bound").alias("_bound"))
    out = stage(close.join(best.hint(SHUFFLED), "qid").where(F.col("alike") >= F.col("_bound") - 1e-6).select("qid", "eid"), "nearest pairs")
    discard(asked, close)
    return out


def best_two(queries: DataFrame, entries: DataFrame, within: Column | None = None, needed: Column | None = None, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(qid, eid, score, edge): for each query at least its two most similar entries, ties at the second place included, whatever their similarity.

    queries have qid, query and other columns, entries eid, norm and other ones; within, a
    condition over them, limits the entries that a query may get. needed (2) says how many
    of its best entries a query has to get.
    """
    queries, entries = stage(queries.withColumn("_needed", needed if needed is not None else F.lit(2)), "queries"), stage(entries.where(F.col("norm") != ""), "entries")
    q, e = queries.select("qid", "query"), entries.select("eid", "norm")

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(queries, "qid").join(entries, "eid")
        rows = rows.where(within) if within is not None else rows
        return rows.select("qid", "eid", similarity(F.col("query"), F.col("norm")).alias("score"), boundary_aligned(F.col("query"), F.col("norm")).alias("edge"))

    inside = containing(e, q, "norm", "query").select("qid", "eid").unionByName(containing(q, e, "query", "norm").select("qid", "eid"))
    found, left = stage(scored(inside.distinct()), "contained"), queries
    if within is None:
        # segments short enough to find a second entry have three or four characters of a name of twenty, which very many entries share
        more = scored(nearest_of_all(left.where(F.length("query").between(1, BITS)), e).join(found.hint(SHUFFLED), ["qid", "eid"], "left_anti"))
        found = stage(found.unionByName(more), "nearest of all")
        left = stage(left.where(~F.length("query").between(1, BITS)), "long queries")
        if left.isEmpty():
            return found
    for percent in rounds:
        more = scored(near(left.select("qid", "query"), e, percent).join(found.hint(SHUFFLED), ["qid", "eid"], "left_anti"))
        found = stage(found.unionByName(more), "near")
        done = found.where(F.col("score") >= F.lit(percent / 100).cast("float")).groupBy("qid").agg(F.count("*").alias("_n"))
        left = stage(left.join(done, "qid", "left").where(F.coalesce("_n", F.lit(0)) < F.col("_needed")).drop("_n"), "open queries")
        if left.isEmpty():
            return found
    # some entries, so that every query has a second best that rules lengths and pairs out
    some = [r["eid"] for r in e.select("eid").limit(SEEDS).collect()]
    seeds = left.select("qid", F.explode(F.array(*map(F.lit, some)) if some else F.array().cast("array<bigint>")).alias("eid"))
    found = stage(found.unionByName(scored(seeds.join(found.hint(SHUFFLED), ["qid", "eid"], "left_anti"))), "seeded")
    place = Window.partitionBy("qid").orderBy(F.desc("score"))
    least = found.join(left.select("qid", "_needed"), "qid").withColumn("_k", F.row_number().over(place)).where("_k = _needed").select("qid", (F.col("score").cast("double") - 1e-6).alias("_least"))
    sizes = e.groupBy(F.length("norm").alias("_size")).agg(F.count("*").alias("_n")).agg(F.sort_array(F.collect_list("_size")).alias("_sizes"))
    m = F.length("query")
    fits = lambda s: F.least(s, m) >= F.col("_least") * F.greatest(s, m)
    bounded = left.join(least, "qid", "left").withColumn("_least", F.coalesce("_least", F.lit(0.0)))
    asked = bounded.join(F.broadcast(sizes)).withColumn("_size", F.explode(F.filter("_sizes", fits))).drop("_sizes")
    asked = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = asked.join(entries.withColumns({"_size": F.length("norm"), "_part": F.pmod(F.xxhash64("eid"), F.lit(PARTS)).cast("int")}), ["_size", "_part"])
    met = met.where(within) if within is not None else met
    rest = met.select("qid", "eid", "_least", similarity(F.col("query"), F.col("norm")).alias("score"), boundary_aligned(F.col("query"), F.col("norm")).alias("edge")).where(F.col("score") >= F.col("_least")).drop("_least")
    out = found.join(left, "qid", "left_anti").unionByName(rest.unionByName(found.join(left, "qid", "left_semi")).distinct())
    return out
