"""Alignment of two tokenizers' tokens over the same bytes.

Texts are cut into units where neither tokenizer can join anything (before single spaces
and line feeds); texts with other white space, or with marks of the piece vocabulary, and
all texts of a piece vocabulary that changes what it reads, are one unit. Units are counted
over all texts, and each distinct one is tokenised once in the whole corpus, in Arrow
batches, by a byte-level merge vocabulary A (with a space in front) and by a merge-type
piece vocabulary B (which adds that space itself). A block of units leaves Python as its
tokens, one after the other, each with the byte offset at which it ends.

From there on Spark's higher-order functions do the work. The offsets that both sides have
(array_intersect) cut the tokens into groups. Sorting a side's tokens together with the
cuts puts each cut behind its token, so groups are read off in linear time. A text's
groups and numbers are those of its units in order.

A group links its two last tokens. How often each pair of ids is linked in the whole
corpus follows from how often each unit occurs; that, and whether it is the most that the
pair's B id has with any A id, comes back to the units by a join whose broadcast side holds
only pairs that are more than one in ``HOT`` of all (so it has ``HOT`` rows at most),
while rarer ones, none of which can be frequent, are shuffled. In the same way a bounded
number of the most frequent units is broadcast to the texts with their groups and sums;
all other units of a text join theirs by shuffle.

Defined results: null and empty texts, and texts that either side's tokens don't spell,
have no tokens: all numbers are 0 and groups are the empty string. Each row of docs gives
a row, repeated rows and ids included; equal counts of a B id are all highest. Texts of
any length are read whole. Columns of docs named like the result's are replaced, others
pass through. No row gives no row.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, join_frequent, least_count, map_arrow, stage, stretches
from .token_transducer import byte_letters

#: Units whose tokens a task keeps, as many again of those met in two blocks, and the longest units that are kept.
KEEP, LONGEST_KEPT = 30_000, 64
#: Characters of the texts of a block.
BLOCK = 1 << 18
#: Pairs that are broadcast are more than one in HOT of all.
HOT = 200_000
#: Units broadcast with their groups (none of over LONGEST_KEPT characters).
HEAVY = 1 << 19
#: Bytes of a stretch of texts whose units are counted at once; units (distinct in each stretch), and bytes of text, after which a task passes its counts on.
STRETCH, FLUSH, FLUSH_BYTES = 1 << 22, 600_000, 1 << 26
#: Bytes of a stretch of texts that become numbers of units at once, units of texts whose groups are joined at once (a single text at least).
SPREAD, JOINED = 1 << 21, 1 << 18
#: A token is packed as its end times SCALE plus its id; numbers above all ids mark a cut, and the end of a unit, at an end.
SCALE, CUT, UNIT = 1 << 21, 1 << 20, (1 << 20) + 1
#: How the byte-level vocabulary's texts are split (public), and white space but for space and line feed.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER_WHITE = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
MARK = "▁"
TAIL = ",.;:!?"
#: White space that the first vocabulary joins, or may split in another way than into single units.
RUNS, RUN_ENDS = ("  ", "\n\n\n", "\n\n ", " \n ", " \n\n"), ("\n\n", " \n")
ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Numbers of a unit, which add up to those of a text.
SUMS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")


class TokenPair:
    """Tokens of both vocabularies, as packed ids; the byte length of each id's token."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2

        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        surface = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in added}
        ids = {spec["model"]["vocab"][(m if isinstance(m, str) else " ".join(m)).replace(" ", "")] for m in spec["model"]["merges"]}
        if sorted(surface) != list(range(len(surface))) or min(ids) != 256 or len(ids) != len(spec["model"]["merges"]) or spec["normalizer"] or set(map(len, (surface[i] for i in range(256)))) != {1} or len({surface[i] for i in range(256)}) != 256:
            raise ValueError("a byte-level vocabulary whose ids follow its merges is expected")
        self.bytes_a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={s: i for i, s in surface.items()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        surface_a = [surface[i] for i in range(len(surface))]
        self.surface_b = [bytes([int(p[3:5], 16)]) if self.pieces.IsByte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        if max(len(surface_a), n) > CUT:
            raise ValueError("a vocabulary has too many ids")
        self.len_a, self.len_b = (np.array([*map(len, s)], np.int64) for s in (surface_a, self.surface_b))
        # no piece joins a space mark, or anything at a line end, to what comes before it; nor a letter to a stop
        own = [p for i, p in enumerate(names) if not self.pieces.IsByte(i)]
        self.by_unit = not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in own)
        self.by_letter = not any(re.search(f"[^\\W\\d_][{TAIL}]", p) for p in own)
        # what is made of parts of a text is what is made of it only if no character is changed or left out
        model = sentencepiece_model_pb2.ModelProto.FromString(self.pieces.serialized_model_proto())
        spec = model.normalizer_spec
        self.by_unit = self.by_unit and model.trainer_spec.byte_fallback and spec.add_dummy_prefix and not (spec.remove_extra_whitespaces or spec.precompiled_charsmap)
        self.line = self.pieces.encode("\n")
        self.often: dict[str, tuple[bytes, bytes] | None] = {}
        self.once: dict[str, tuple[bytes, bytes] | None] = {}

    def _packed(self, raw: bytes, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        """Both sides' ids; None if B doesn't spell the bytes (A, which has a token for each byte, always does)."""
        if b"".join(map(self.surface_b.__getitem__, b)) != raw:
            return None
        return array("i", a).tobytes(), array("i", b).tobytes()

    def _bare(self, unit: str) -> tuple[bytes, bytes] | None:
        """Tokens of a unit without a space in front: a line feed before it stands alone and holds off the one that is added."""
        b = self.pieces.encode("\n" + unit)
        if b[: len(self.line)] != self.line:
            return None
        return self._packed(unit.encode(), self.bytes_a.encode_ordinary(unit), b[len(self.line) :])

    def whole(self, text: str) -> tuple[bytes, bytes] | None:
        """Tokens of a whole text."""
        return self._packed(b" " + text.encode(), self.bytes_a.encode_ordinary(" " + text), self.pieces.encode(text))

    def stays_whole(self, text: str) -> bool:
        """Whether a text can't be cut into units."""
        spaced = " " + text
        return not self.by_unit or any(r in spaced for r in RUNS) or spaced.endswith(RUN_ENDS) or MARK in text or OTHER_WHITE.search(text) is not None

    def split(self, text: str) -> list[str] | None:
        """A text's units: "\\n..." is what it is, any other lacks the space in front. None if it has to stay whole."""
        return None if self.stays_whole(text) else text.replace("\n", " \n").split(" ")

    def units(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """How many units each text has, and the units of all in order; one that is a whole text begins with a mark."""
        values = texts.to_pylist()
        whole = [bool(t) and self.stays_whole(t) for t in values]
        if any(whole) or not all(values):
            lists = pa.array([[MARK + t] if w else self.split(t) if t else [] for t, w in zip(values, whole)], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        return pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten()

    def _encode(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Tokens of units; None where one of the sides doesn't spell it."""
        pieces = iter(self.pieces.encode([u for u in units if u and u[0] != "\n" and u[0] != MARK], num_threads=1))
        out = []
        for u in units:
            if not u or u[0] == "\n":
                out.append(self._bare(u or " "))
            elif u[0] == MARK:  # stops, which stand behind a letter
                out.append(self._bare(u[1:]))
            else:
                out.append(self._packed(b" " + u.encode(), self.bytes_a.encode_ordinary(" " + u), next(pieces)))
        return out

    def _known(self, units: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Tokens of units, from two bounded tables of those met before; long ones are encoded each time they occur."""
        often, once = self.often, self.once
        found = {u: often[u] for u in units if u in often}
        again = {u: once[u] for u in units if u in once}
        new = [u for u in units if u not in found and u not in again]
        got = dict(zip(new, self._encode(new)))
        if len(often) + len(again) > KEEP:
            often.clear()
        often.update(islice(again.items(), KEEP))
        if len(once) + len(got) > KEEP:
            once.clear()
        once.update(islice(((u, v) for u, v in got.items() if len(u) <= LONGEST_KEPT), KEEP))
        for u in again:
            once.pop(u, None)
        return {u: found[u] if u in found else again[u] if u in again else got[u] for u in units}

    def forget(self) -> None:
        """Give back the tables of a task: workers stay, and their memory is the next step's."""
        self.often.clear()
        self.once.clear()
        pa.default_memory_pool().release_unused()

    def block(self, texts: list[str | None], units: bool = False) -> tuple[list[tuple[bytes, bytes]], list[list[int]]]:
        """Tokens of the distinct units of some texts, and each text as numbers of units; with units, the texts are units themselves."""
        if units:
            cut = [None if t.startswith(MARK) else [t] for t in texts]
            texts = [t.removeprefix(MARK) for t in texts]
        else:
            cut = [self.split(t) if t else [] for t in texts]
        parts: dict[str, tuple[str, ...]] = {}
        for u in dict.fromkeys(chain.from_iterable(filter(None, cut))):
            core = u.rstrip(TAIL) if self.by_letter else u
            # neither side joins a letter with what follows it here
            parts[u] = (core, MARK + u[len(core) :]) if core != u and core[-1:].isalpha() else (u,)
        known = self._known([*dict.fromkeys(chain.from_iterable(parts.values()))])
        unspelt = {u for u, p in parts.items() if any(known[x] is None for x in p)} if None in known.values() else set()
        tokens = [got for got in known.values() if got is not None]
        place = dict(zip((u for u, got in known.items() if got is not None), range(len(tokens))))
        number = {u: tuple(map(place.__getitem__, p)) for u, p in parts.items() if u not in unspelt}
        at = []
        for text, own in zip(texts, cut):
            if own is None or unspelt and not unspelt.isdisjoint(own):
                got, own = self.whole(text), []
                if got is not None:
                    at.append([len(tokens)])
                    tokens.append(got)
                    continue
            at.append([*chain.from_iterable(map(number.__getitem__, own))])
        return tokens, at


@lru_cache(maxsize=2)
def token_pair(byte_path: str, piece_path: str) -> TokenPair:
    return TokenPair(byte_path, piece_path)


def _side(parts: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A side's tokens, with their ends in the block, and how many each unit has."""
    ids, sizes = np.frombuffer(b"".join(parts), np.int32), np.array([len(p) // 4 for p in parts], np.int64)
    return np.cumsum(lengths[ids]) * SCALE + ids, sizes


def tokenise(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text", units: bool = False) -> DataFrame:
    """Blocks of texts, which with units are units themselves.

    a_tokens, b_tokens: tokens of the block's distinct units in order; a_ends, b_ends: where they
    end; units: where units end; sizes: each unit's tokens, A's times 2^32 plus B's; texts: the
    other columns of docs (kept) with the numbers (from 0) of the text's units (at).
    """
    longs = T.ArrayType(T.LongType(), False)
    keep = T.StructType([f for f in docs.schema if f.name != text_col])
    texts = T.StructType([T.StructField("kept", keep, False), T.StructField("at", T.ArrayType(T.IntegerType(), False), False)])
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in keep.names)).alias("kept"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*(T.StructField(n, longs, False) for n in ("a_tokens", "a_ends", "b_tokens", "b_ends", "units", "sizes")), T.StructField("texts", T.ArrayType(texts, False), False)])
    kind = to_arrow_schema(schema).field("texts").type
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]):
        pair = token_pair(byte_path, piece_path)
        for batch in batches:
            kept, column = batch.column("kept"), batch.column("text")
            lo, size, block = 0, 0, []
            for k in range(batch.num_rows):
                block.append(column[k].as_py())
                size += len(block[-1] or "") + 1
                if size < BLOCK and k + 1 < batch.num_rows:
                    continue
                gc.disable()  # a block makes many small values and no cycles
                tokens, at = pair.block(block, units)
                gc.enable()
                a, a_sizes = _side([x[0] for x in tokens], pair.len_a)
                b, b_sizes = _side([x[1] for x in tokens], pair.len_b)
                a_ends, b_ends = a // SCALE * SCALE + CUT, b // SCALE * SCALE + CUT
                numbers = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([*map(len, at)])].astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(at), np.int32)))
                arrays = {"a_tokens": a, "a_ends": a_ends, "b_tokens": b, "b_ends": b_ends, "units": a_ends[np.cumsum(a_sizes) - 1] + UNIT - CUT, "sizes": (a_sizes << 32) + b_sizes}
                yield {n: one(pa.array(v, pa.int64())) for n, v in arrays.items()} | {"texts": one(pa.StructArray.from_arrays([kept.slice(lo, len(block)), numbers], ["kept", "at"])).cast(kind)}
                lo, size, block = k + 1, 0, []
        pair.forget()

    return map_arrow(rows, run, schema)


def _groups(tokens: str, *marks: str) -> Column:
    """A side's groups as texts of ids: its tokens sorted with the marks, each of which follows the token that ends there."""
    numbers = F.transform(F.sort_array(F.concat(tokens, *marks)), lambda x: x.bitwiseAND(SCALE - 1))
    shown = F.concat(F.array_join(numbers.cast("array<string>"), ","), F.lit(","))
    shown = F.replace(F.replace(shown, F.lit(f",{CUT},"), F.lit(";")), F.lit(f"{UNIT},"), F.lit("/"))
    return F.slice(F.split(shown, ";"), 1, F.size("cuts"))  # behind the last cut there is an empty rest


def aligned(blocks: DataFrame) -> DataFrame:
    """Rows of texts: kept, n_a, n_b and groups (``a1,a2|b1``, in order), by higher-order functions alone."""
    rows = blocks.withColumn("cuts", F.array_intersect("a_ends", "b_ends"))
    rows = rows.select("texts", "sizes", _groups("a_tokens", "cuts", "units").alias("a"), _groups("b_tokens", "cuts").alias("b"))
    joined = F.array_join(F.zip_with("a", "b", lambda x, y: F.concat(x, F.lit("|"), y)), ";")
    rows = rows.select("texts", "sizes", F.split(F.replace(joined, F.lit(";/"), F.lit("/")), "/").alias("units"))
    text = lambda t: F.struct(
        t["kept"].alias("kept"),
        F.aggregate(t["at"], F.lit(0).cast("long"), lambda n, i: n + F.get("sizes", i)).alias("size"),
        F.array_join(F.transform(t["at"], lambda i: F.get("units", i)), ";").alias("groups"),
    )
    rows = rows.select(F.inline(F.transform("texts", text)))
    return rows.select("kept", F.shiftright("size", 32).alias("n_a"), F.col("size").bitwiseAND((1 << 32) - 1).alias("n_b"), "groups")


def unit_counts(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text") -> DataFrame:
    """(unit, c): how often each unit occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]):
        pair = token_pair(byte_path, piece_path)
        found: list[tuple[pa.Array, np.ndarray]] = []
        held = read = 0

        def pack() -> dict:
            coded = pa.concat_arrays([u for u, _ in found]).dictionary_encode()
            return {"unit": coded.dictionary, "c": np.bincount(coded.indices.to_numpy(), np.concatenate([n for _, n in found]), len(coded.dictionary)).astype(np.int64)}

        for batch in batches:
            for part in stretches(batch, "text", STRETCH):
                coded = pair.units(part.column("text"))[1].dictionary_encode()
                found.append((coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))))
                held, read = held + len(coded.dictionary), read + part.nbytes
                if held > FLUSH or read > FLUSH_BYTES:
                    yield pack()
                    found.clear()
                    held = read = 0
        if found:
            yield pack()
            found.clear()
        pair.forget()

    found = map_arrow(docs.select(F.col(f"`{text_col}`").alias("text")), run, "unit string, c long")
    return found.groupBy("unit").agg(F.sum("c").alias("c"))


def unit_table(counts: DataFrame, byte_path: str, piece_path: str, hot: int = HOT) -> DataFrame:
    """(unit, c, groups, SUMS...): each unit's groups, and what each time that it occurs adds to its text's numbers."""
    blocks = tokenise(counts.select("unit", "c", F.col("unit").alias("text")), byte_path, piece_path, units=True)
    units = stage(aligned(blocks).select(F.monotonically_increasing_id().alias("u"), "kept.*", "n_a", "n_b", "groups"), "aligned units")
    last = lambda part: F.substring_index(F.substring_index("group", "|", part), ",", -1).cast("int")
    links = units.where("groups <> ''").select("u", "c", F.explode(F.split("groups", ";")).alias("group")).select("u", "c", last(1).alias("a"), last(-1).alias("b"))
    pairs = links.groupBy("a", "b").agg(F.sum("c").alias("n"))
    pairs = stage(pairs.join(pairs.groupBy("b").agg(F.max("n").alias("most")), "b").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "linked pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    frequent = pairs.where(F.col("n") * hot > total)
    rare = pairs.where(F.col("n") * hot <= total).select("a", "b", F.col("n").alias("n1"), F.col("best").alias("best1"))
    # one row for all frequent pairs of a unit, one for each of its rare pairs
    is_rare = F.col("n").isNull()
    seen = links.join(F.broadcast(frequent), ["a", "b"], "left").groupBy("u", F.when(is_rare, F.col("a")).alias("a"), F.when(is_rare, F.coalesce("b", "a")).alias("b"))
    seen = seen.agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("best").alias("best"))
    known = seen.where("a is null").select("u", "m", "n", "best")
    known = known.unionByName(seen.where("a is not null").drop("n", "best").join(rare, ["a", "b"]).select("u", "m", (F.col("m") * F.col("n1")).alias("n"), (F.col("m") * F.col("best1")).alias("best")))
    sums = known.groupBy("u").agg(F.sum("m").alias("n_groups"), F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    table = units.join(sums, "u", "left").select("unit", "c", "groups", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in SUMS))
    out = stage(table, "unit table", "zstd")
    discard(units, pairs)
    return out


def _folded(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, the high ones of which, nearly all alike, stand together."""
    return zlib.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unfolded(data: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.tobytes(), "<i4")


def spread(rows: DataFrame, heavy: pa.Table, byte_path: str, piece_path: str) -> DataFrame:
    """Texts as numbers of units, and their units that aren't heavy.

    For each text: row, kept, the sums of its heavy units, and its units in order (at, packed by _folded): places in heavy,
    or -1, -2, ... for its others. For each of these: row, unit, the number that stands for it (k), how often it occurs (m).
    """
    table = rows.sparkSession.sparkContext.broadcast((heavy["unit"].combine_chunks(), np.array([heavy[n].to_numpy() for n in SUMS]).astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]):
        pair = token_pair(byte_path, piece_path)
        often, values = table.value
        for batch in batches:
            for part in stretches(batch, "text", SPREAD):
                sizes, units = pair.units(part.column("text"))
                coded, a = units.dictionary_encode(), len(sizes)
                unit, text = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(a), sizes)
                at = pc.fill_null(pc.index_in(coded.dictionary, often), -1).to_numpy(zero_copy_only=False)[unit]
                ends = np.r_[0, np.cumsum(sizes)]
                hit = at >= 0
                sums = []
                for v in values:
                    run_ = np.r_[0, np.cumsum(np.where(hit, v[at] if len(v) else 0, 0))]
                    sums.append(run_[ends[1:]] - run_[ends[:-1]])
                others, back, m = np.unique(text[~hit] * len(coded.dictionary) + unit[~hit], return_inverse=True, return_counts=True)
                of, name = np.divmod(others, max(len(coded.dictionary), 1))
                k = np.arange(len(others)) - np.searchsorted(of, of)
                at[~hit] = -1 - k[back]
                b, kept, row = len(others), part.column("kept"), part.column("row").to_numpy()
                numbers = pa.array([_folded(at[lo:hi]) for lo, hi in zip(ends, ends[1:])], pa.binary())
                yield {
                    "row": np.r_[row, row[of]], "kept": pa.concat_arrays([kept, pa.nulls(b, kept.type)]), "at": pa.concat_arrays([numbers, pa.nulls(b, numbers.type)]),
                    "unit": pa.concat_arrays([pa.nulls(a, pa.string()), coded.dictionary.take(pa.array(name))]), "k": np.r_[np.zeros(a), k].astype(np.int32), "m": np.r_[np.zeros(a, np.int64), m],
                } | {n: np.r_[s, np.zeros(b, np.int64)] for n, s in zip(SUMS, sums)}
        pair.forget()

    kept = rows.schema["kept"]
    longs = [T.StructField(n, T.LongType()) for n in ("m", *SUMS)]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("kept", kept.dataType), T.StructField("at", T.BinaryType()), T.StructField("unit", T.StringType()), T.StructField("k", T.IntegerType()), *longs])
    return map_arrow(rows, run, schema)


def shown_groups(at: list[np.ndarray], own: pa.ListArray, often: pa.Array) -> pa.Array:
    """Each text's groups in order, in Arrow alone: one Python object for each frequent unit would fill a worker."""
    ends = np.r_[0, np.cumsum([*map(len, at)])]
    numbers = np.concatenate(at).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy().astype(np.int64)
    first = np.cumsum(sizes) - sizes
    parts = pc.split_pattern(own.flatten(), " ", max_splits=1)
    place = np.empty(len(parts), np.int64)
    place[np.repeat(first, sizes) + pc.list_element(parts, 0).cast(pa.int64()).to_numpy()] = np.arange(len(parts)) + len(often)
    others = np.flatnonzero(numbers < 0)
    numbers[others] = place[np.repeat(first, np.diff(ends))[others] - 1 - numbers[others]]
    pool = pa.concat_arrays([often, pc.list_element(parts, 1).cast(often.type)])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pool.take(pa.array(numbers))), pa.scalar(";", pool.type))


def joined_groups(rows: DataFrame, heavy: pa.Table, digest: bool) -> DataFrame:
    """kept, SUMS, and the groups of each text in order (or with digest, their SHA-256), from its numbers of units (at) and its own units' groups (own: texts of k, a space and the groups)."""
    table = rows.sparkSession.sparkContext.broadcast(heavy["groups"].combine_chunks())
    names = ["kept", *SUMS]

    def run(batches: Iterator[pa.RecordBatch]):
        often = table.value.cast(pa.large_string())
        for batch in batches:
            lo, size, block = 0, 0, []
            for k, x in enumerate(batch.column("at")):
                block.append(_unfolded(x.as_py()))
                size += len(block[-1])
                if size < JOINED and k + 1 < batch.num_rows:
                    continue
                part = batch.slice(lo, len(block))
                shown = shown_groups(block, part.column("own"), often)
                if digest:
                    shown = [hashlib.sha256(x.as_buffer()).hexdigest() if x.as_buffer().size else "" for x in shown]
                yield {n: part.column(n) for n in names} | {"shown": shown}
                lo, size, block = k + 1, 0, []
        pa.default_memory_pool().release_unused()

    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField("shown", T.StringType())])
    return map_arrow(rows.select(*names, "at", "own"), run, schema)


def align(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text", digest: bool = False, hot: int = HOT, heavy: int = HEAVY) -> DataFrame:
    """docs, without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups; with digest, groups_sha256 instead of groups."""
    last = "groups_sha256" if digest else "groups"
    taken = {last, *ADDED}
    names = [n for n in docs.columns if n != text_col and n not in taken]
    rows = docs.select(F.struct(*([F.col(f"`{n}`") for n in names] or [F.lit(0).alias("none")])).alias("kept"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    counts = stage(unit_counts(docs, byte_path, piece_path, text_col), "unit counts")
    units = unit_table(counts, byte_path, piece_path, hot)
    discard(counts)
    short = F.length("unit") <= LONGEST_KEPT
    often = short & (F.col("c") >= least_count(units.where(short), heavy))
    most = units.where(often).select("unit", "c", "groups", *SUMS).toArrow().sort_by([("c", "descending"), ("unit", "ascending")])
    parts = stage(spread(rows, most, byte_path, piece_path), "texts as units", "zstd")
    seldom = units.where(~often)
    own = join_frequent(parts.where("unit is not null").select("row", "unit", "k", "m"), seldom, "unit", "row", seldom.select("unit", F.col("c").alias("n")))
    own = own.groupBy("row").agg(F.collect_list(F.concat(F.col("k").cast("string"), F.lit(" "), "groups")).alias("own"), *(F.sum(F.col("m") * F.col(n)).alias(f"own_{n}") for n in SUMS))
    texts = parts.where("unit is null").select("row", "kept", "at", *SUMS).join(own, "row", "left")
    texts = texts.withColumns({n: F.col(n) + F.coalesce(f"own_{n}", F.lit(0)) for n in SUMS})
    out = joined_groups(texts, most, digest)
    return out.select(*(F.col("kept")[n].alias(n) for n in names), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", F.col("shown").alias(last))
