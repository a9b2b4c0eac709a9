"""MinHash near-duplicates: banded candidates, odd sketches, confirmation on whole sets.

Each document becomes the set of its word shingles (64-bit hashes). Documents with equal
sets form one class (named by 64 bits of the set's digest), so copies never meet again
below. For each class a vector of MinHash
values is drawn; bands of it give buckets, and the values, each hashed with its place into
one bit that it flips, give the odd sketch: the population count of two sketches' XOR
estimates the similarity, most precisely where it is high. Candidates whose sketches lie
far below the threshold are dropped (by six standard errors), all others are confirmed
on the whole sets.

No bucket is expanded into pairs: its classes are first compared with the bucket's smallest
only. Joins on a bucket, its smallest class or a class of many copies deal the rows of each
frequent key to several tasks. Buckets that the confirmed links leave in several components are completed exactly:
they are joined into groups, and pairs of blocks of a group, each of bounded size, compare
sketches and, where those are near, whole sets of different components as matrix products,
passing on nothing but links. So no pair that shares a bucket is left uncompared unless it
is joined already.

Defined results: documents without words have an empty set and link with nothing; documents
with fewer words than a shingle have the whole sequence as their one shingle; a null text is
an empty one. Texts are read whole; extra columns are ignored; an empty table gives no rows.
Rows are documents of their own even if ids repeat: each row has the component of its own
text. A component's id is the smallest there is; null ids count only where there is no other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_frequent, map_arrow, stage, words_of
from .graph import connected_components

#: Bands and values in each: two sets of similarity 0.8 miss each other with probability (1 - 0.8**5)**36 = 6e-7.
BANDS, ROWS = 36, 5
#: Bits of an odd sketch, as 64-bit words.
SKETCH_WORDS = 16
#: Shingles and classes of a block in the exact completion.
BLOCK_SHINGLES, BLOCK_ROWS = 1_000_000, 1024
#: Ids that may be broadcast to pick their texts.
BROADCAST_IDS = 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    acc = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        acc = _mix(acc ^ h[k : len(h) - width + 1 + k])
    acc.sort()
    return acc[np.r_[True, acc[1:] != acc[:-1]]]


@lru_cache(maxsize=2)
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    s = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return s[:n] | np.uint64(1), s[n:]


def minhash(hashes: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values (upper 32 bits of n multiply-shift hashes)."""
    mul, add = _seeds(n)
    best = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    step = max(1, 65536 // n)
    for lo in range(0, len(hashes), step):
        part = hashes[lo : lo + step]
        np.minimum(best, (part[:, None] * mul + add).min(axis=0), out=best)
    return best


def sketch(values: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """The odd sketch: each value, with its place, flips one bit."""
    bit = _mix(values ^ _mix(np.arange(len(values), dtype=np.uint64))) % np.uint64(64 * words)
    flips = np.bincount(bit.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def class_of(hashes: np.ndarray) -> int | None:
    """The class of a set, 64 bits of its digest; None if it is empty."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True) if len(hashes) else None


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, print, text): print, a hash of the text, tells rows of one id apart."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, print, n_shingles, class, band keys and odd sketch of each document."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [shingles(t.as_py(), width) for t in part.column("text")]
                bands, sketches = [], []
                for s in sets:
                    if not len(s):
                        bands.append(None)
                        sketches.append(None)
                        continue
                    values = minhash(s, BANDS * ROWS)
                    keys = np.arange(BANDS, dtype=np.uint64)
                    for column in values.reshape(BANDS, ROWS).T:
                        keys = _mix(keys ^ column)
                    bands.append(keys.view(np.int64))
                    sketches.append(sketch(values).view(np.int64))
                yield {"id": part.column("id"), "print": part.column("print"), "n_shingles": [len(s) for s in sets], "cls": [class_of(s) for s in sets], "bands": bands, "sketch": sketches}

    return map_arrow(_rows(docs, id_col, text_col), run, "id long, print long, n_shingles long, cls long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the classes of which wanted has a document (id, print); so few that they fit a broadcast spare a shuffle of all texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                sets = [shingles(t.as_py(), width) for t in batch.slice(lo, 1024).column("text")]
                yield {"cls": [class_of(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    keys = wanted.select(F.col("id").alias("_id"), F.col("print").alias("_print"))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    rows = _rows(docs, id_col, text_col)
    rows = rows.join(keys, rows["id"].eqNullSafe(F.col("_id")) & (rows["print"] == F.col("_print")), "left_semi")
    return map_arrow(rows.select("text"), run, "cls long, shingles binary").where("cls is not null").dropDuplicates(["cls"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            keep.append(100 * common >= percent * (len(a) + len(b) - common))
        yield {c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")}


def sketch_limit(percent: int) -> int:
    """Differing bits beyond which a pair lies six standard errors below the threshold."""
    k, bits = BANDS * ROWS, 64 * SKETCH_WORDS
    s = percent / 100
    odd = lambda sim: bits / 2 * (1 - (1 - 2 / bits) ** (2 * k * (1 - sim)))
    sampling = odd(s - (s * (1 - s) / k) ** 0.5) - odd(s)
    collisions = 2 * odd(s) / (2 * bits) ** 0.5
    return int(odd(s) + 6 * (sampling**2 + collisions**2) ** 0.5) + 1


def _block_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links between the rows of side 0 and those of side 1 (or within side 0 alone) of different components."""
    ids, comp, n, side = (rows[c].to_numpy() for c in ("id", "c", "n_shingles", "side"))
    sketches = np.stack([np.frombuffer(x.as_buffer(), np.uint64) for x in rows["sketch"]])
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    found: list[tuple[int, int]] = []
    limit, step = sketch_limit(percent), max(1, 4_000_000 // (SKETCH_WORDS * max(1, len(right))))
    for lo in range(0, len(left), step):
        a = left[lo : lo + step]
        ok = (comp[a][:, None] != comp[right]) & (100 * np.minimum(n[a][:, None], n[right]) >= percent * np.maximum(n[a][:, None], n[right]))
        if right is left:
            ok &= a[:, None] < right[None, :]
        i, j = np.nonzero(ok)
        for part in range(0, len(i), 50_000):
            x, y = a[i[part : part + 50_000]], right[j[part : part + 50_000]]
            near = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64) <= limit
            x, y = x[near], y[near]
            common = _common(sets, x, y)
            hit = 100 * common >= percent * (n[x] + n[y] - common)
            found += zip(ids[x[hit]].tolist(), ids[y[hit]].tolist())
    return pa.table({"a": pa.array([max(p) for p in found], pa.int64()), "b": pa.array([min(p) for p in found], pa.int64())})


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (x, y), exactly."""
    if len(x) < 2000:
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x.tolist(), y.tolist())], np.int64)
    rows, cols = np.unique(x), np.unique(y)
    members = np.unique(np.concatenate([rows, cols]))
    keys = np.concatenate([sets[m] for m in members])
    owner = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    unique, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    keep = count[place] > 1
    number = np.cumsum(count > 1) - 1
    place, owner = number[place[keep]], owner[keep]
    r, c = np.searchsorted(members, rows), np.searchsorted(members, cols)
    total = np.zeros((len(rows), len(cols)), np.float32)
    width = 4096
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):  # matrix products over slices of the shared shingles
        s, e = np.searchsorted(place, (lo, lo + width))
        m = np.zeros((len(members), width), np.float32)
        m[owner[s:e], place[s:e] - lo] = 1
        total += m[r] @ m[c].T
    return total[np.searchsorted(rows, x), np.searchsorted(cols, y)].astype(np.int64)


def _rest(inside: DataFrame, facts: DataFrame, sets_of, percent: int, spent: list[DataFrame]) -> DataFrame:
    """Links (a, b) between different components within a group, each pair of blocks of a group being a task of bounded size.

    inside has cls, c (component) and grp; nothing but links is passed on. Tables that may go
    after that are added to spent.
    """
    inside = stage(inside, "open-members")
    rows = stage(inside.join(facts.select("cls", "n_shingles", F.col("sketch").alias("words")), "cls").join(sets_of(inside.select("cls")), "cls"), "open-sets")
    spent += [inside, rows]
    blocks = rows.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2")
    rows = join_frequent(rows, blocks.select("grp", "blocks"), "grp", "cls").withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), F.col("cls").alias("id"), "c", "n_shingles", "words", "shingles")

    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            words = [w.values.to_numpy().tobytes() for w in batch.column("words")]
            yield {f: batch.column(f) for f in ("grp", "i", "j", "side", "id", "c", "n_shingles", "shingles")} | {"sketch": words}

    packed = map_arrow(rows, pack, "grp long, i int, j int, side int, id long, c long, n_shingles long, shingles binary, sketch binary")
    return packed.groupBy("grp", "i", "j").applyInArrow(lambda table: _block_links(table, percent), "a long, b long").distinct()


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, print, n_shingles, cls) of all rows, and (cls, best) of all classes: the first (id, print) of the class's component."""
    wide = stage(signatures(docs, id_col, text_col, width), "signatures")
    sig = stage(wide.select("id", "print", "n_shingles", "cls"), "document-classes")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print"))
    classes = stage(wide.where("cls is not null").groupBy("cls").agg(best.alias("best"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    discard(wide)
    spent: list[DataFrame] = []
    slots = classes.select("cls", F.explode("bands").alias("slot"))
    first = slots.groupBy("slot").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1")
    shared = stage(join_frequent(slots, first.select("slot", "head"), "slot", "cls", first.select("slot", "n")), "buckets")  # only buckets with two classes or more
    facts = classes.select("cls", "n_shingles", "sketch")
    # the smaller set has at least percent of the larger one, and sketches are near
    differing = lambda a, b: sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, SKETCH_WORDS)), F.bit_count(a[0].bitwiseXOR(b[0])))
    likely = lambda na, nb, sa, sb: (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differing(sa, sb) <= sketch_limit(percent))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(cls, shingles) of the classes wanted (distinct)."""
        return _sets(docs, id_col, text_col, width, classes.join(wanted, "cls", "left_semi").select("best.id", "best.print"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that the whole sets confirm."""
        wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        sets = stage(sets_of(wanted), "sets")
        spent.append(sets)
        both = join_frequent(pairs, sets.toDF("b", "sb"), "b", "a").join(sets.toDF("a", "sa"), "a")
        return map_arrow(both, lambda it: _confirm(it, percent), "a long, b long")

    pairs = stage(shared.where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    candidates = join_frequent(pairs, facts.toDF("b", "nb", "kb"), "b", "a").join(facts.toDF("a", "na", "ka"), "a").where(likely(F.col("na"), F.col("nb"), F.col("ka"), F.col("kb"))).select("a", "b")
    candidates = stage(candidates, "candidates")
    links = stage(confirmed(candidates), "links")
    part = connected_components(links, "a", "b")
    discard(pairs, candidates, links, *spent)

    # buckets that are still in several components (a bucket's only pair has been compared), joined into groups
    tagged = stage(shared.join(part.withColumnRenamed("v", "cls"), "cls", "left").select("slot", "cls", "head", F.coalesce("component", "cls").alias("c")), "tagged")
    discard(shared)
    sizes = tagged.groupBy("slot").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("n")).where("c1 <> c2 and n > 2")
    open_ = stage(join_frequent(tagged, sizes.select("slot"), "slot", "cls", sizes.select("slot", "n")).select("cls", "head", "c").distinct(), "open-buckets")
    grouped = connected_components(open_, "cls", "head")
    inside = open_.select("cls", "c").distinct().join(grouped.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "c", F.coalesce("component", "cls").alias("grp"))
    more = stage(_rest(inside, facts, sets_of, percent, spent), "links")
    discard(tagged, open_, *spent)
    if not more.isEmpty():
        part = connected_components(part.select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
    # the first document of each component
    tied = stage(classes.select("cls", "best").join(part.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "best", F.coalesce("component", "cls").alias("component")), "class-components")
    several = tied.groupBy("component").agg(F.min("best").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = join_frequent(tied, several.select("component", "first"), "component", "cls", several.select("component", "n"), "left")
    joined = stage(joined.select("cls", F.coalesce("first", "best").alias("best")), "first-documents")
    discard(classes, tied)
    return sig, joined


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id (smallest id reachable by links, itself included), kept (the id is its component's), for every row.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets.
    """
    sig, classes = _linked(docs, id_col, text_col, width, percent)
    out = join_frequent(sig, classes, "cls", "id", how="left")
    component = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component, the first by id and then by hash of the text; rows without words stay."""
    sig, classes = _linked(docs, id_col, text_col, width, percent)
    # a component's first row by (id, print); rows alike in both are one text, of which one stays
    first = stage(classes.select("best.id", "best.print").distinct(), "first-rows")
    often = stage(sig.where("cls is not null").groupBy("id", "print").agg(F.count("*").alias("n")).where("n > 1").select("id", "print"), "repeated-rows")
    blank = sig.where("cls is null").select("id", "print").distinct()
    text = F.xxhash64(F.col(f"`{text_col}`"))
    mine = F.col(f"`{id_col}`").cast("long")
    same = mine.eqNullSafe(F.col("id_")) & (text == F.col("print_"))
    pick = lambda keys: docs.join(keys.toDF("id_", "print_"), same, "left_semi")
    if often.isEmpty():
        return pick(first.unionByName(blank)).select(*docs.columns)
    alike = first["id"].eqNullSafe(often["id"]) & (first["print"] == often["print"])
    once, several = first.join(often, alike, "left_anti"), first.join(often, alike, "left_semi")
    single = pick(several).withColumn("print__", text).dropDuplicates([id_col, "print__"]).drop("print__")
    return pick(once.unionByName(blank)).unionByName(single).select(*docs.columns)
