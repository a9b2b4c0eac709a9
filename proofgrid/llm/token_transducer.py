"""Token counts by a compiled finite-state transducer.

The words that a byte-level merge tokenizer splits off are read symbol by symbol (a
symbol is a byte, or a word's last byte). After each symbol a state holds all that later
symbols can depend on: the longest ending of the word that begins a token, and for each
place within it the last token of the encoding up to there and its count relative to the
current one. There are finitely many such states, so the transducer is deterministic;
transitions carry the change in emitted tokens and are compiled when first taken, as
lazy automata do. The last token at a place is the one token that ends there, builds
itself and stays apart from the last token before it.

White space ends every word, so the map of a chunk of text from start state to end state
and count is fixed once the first white space has passed: it is kept as the open head,
the count behind it and the open tail, and such maps compose. Long texts are cut into
chunks whose maps are combined by a parallel prefix scan.

Defined results: a null or empty text counts 0; special strings inside texts count one
token, as the library's default; texts of any length are read whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow
from .merge_rules import Seams

#: Units (and words) and their characters whose counts a worker keeps of each generation; longer units are not kept. Compiled states, before it starts afresh.
KEEP_UNITS, KEEP_CHARS, LONGEST_KEPT, KEEP_STATES = 250_000, 5_000_000, 64, 150_000
#: Characters of a chunk; longer texts are composed from the maps of their chunks.
CHUNK = 1 << 16
#: Added to a byte's letter to give the symbol of a word's last byte.
LAST = 0x1000
WHITE = regex.compile(r"\s")
#: Upper-case letters younger than Python's character data, with their lower case.
YOUNG = str.maketrans({"\ua7cb": "\u0264", "\ua7dc": "\u019b"})


def byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    printable = set(chain(range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)))
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class CountingTransducer:
    """Counts the tokens of texts as the tokenizer in a tokenizers JSON file does."""

    START = 0

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a word BPE with NFC, white space and lower-case normalisers is expected")
        suffix = model["end_of_word_suffix"]
        mark = lambda t: t[: -len(suffix) - 1] + chr(ord(t[-len(suffix) - 1]) + LAST) if t.endswith(suffix) and len(t) > len(suffix) else t
        ranks: dict[tuple[str, str], int] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            ranks.setdefault((mark(a), mark(b)), k)
        self.seams = Seams(lambda x, y: ranks.get((x, y)))
        self.tokens = {mark(t) for t in model["vocab"]}
        self.begins = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.letters = byte_letters()
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        # of two generations of each table the older goes when the younger is full; what is met again passes to the younger
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.words_met: dict[str, int] = {}
        self.older_words: dict[str, int] = {}
        self.kept = self.kept_words = 0
        self._reset()

    # States: (the ending that begins a token, the last tokens and relative counts at its places)
    def _reset(self) -> None:
        self.states = [("", ((None, 0),))]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        ending, places = self.states[state]
        grown = ending + symbol
        here = None
        for size in range(len(grown), 0, -1):
            token = grown[len(grown) - size :]
            last, count = places[-size]
            if token in self.tokens and self.seams.edges(token) is not None and (last is None or self.seams.apart(last, token)):
                here = (token, count + 1)
                break
        if here is None:
            raise ValueError(f"no token ends with {symbol!r}")
        if ord(symbol) >= LAST:
            move = (self.START, here[1])
        else:
            size = next(k for k in range(len(grown), -1, -1) if not k or grown[len(grown) - k :] in self.begins)
            kept = (*places, here)[-size - 1 :]
            key = (grown[len(grown) - size :], tuple((t, c - here[1]) for t, c in kept))
            to = self.number.get(key)
            if to is None:
                to = self.number[key] = len(self.states)
                self.states.append(key)
                self.moves.append({})
            move = (to, here[1])
        self.moves[state][symbol] = move
        return move

    def count_word(self, word: str) -> int:
        """Tokens of one word, by a walk through the transducer."""
        if len(self.states) > KEEP_STATES:
            self._reset()
        letters, moves = self.letters, self.moves
        symbols = [letters[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] = chr(ord(symbols[-1]) + LAST)
        state = total = 0
        for s in symbols:
            move = moves[state].get(s)
            if move is None:
                move = self._compile(state, s)
            state = move[0]
            total += move[1]
        return total

    def count_unit(self, unit: str) -> int:
        """Tokens of a stretch without blanks and line ends: special strings, normalising, words."""
        total, pos, parts = 0, 0, [unit]
        if self.added is not None and "<|" in unit:
            parts = []
            for m in self.added.finditer(unit):
                parts.append(unit[pos : m.start()])
                pos = m.end()
                total += 1
            parts.append(unit[pos:])
        for p in filter(None, parts):
            text = unicodedata.normalize("NFC", p)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
            if not text.isascii():
                text = text.translate(YOUNG)
            met = self.words_met
            for word in self.words.findall(text):
                n = met.get(word)
                total += self._word(word) if n is None else n
        return total

    def _word(self, word: str) -> int:
        """Tokens of a word that this generation hasn't met."""
        if len(word) > LONGEST_KEPT:
            return self.count_word(word)
        n = self.older_words.get(word)
        if n is None:
            n = self.count_word(word)
        self.kept_words += len(word)
        if len(self.words_met) >= KEEP_UNITS or self.kept_words > KEEP_CHARS:
            self.older_words, self.words_met, self.kept_words = self.words_met, {}, len(word)
        self.words_met[word] = n
        return n

    def count_units(self, units: list[str]) -> int:
        counts = self.counts
        new = set(units).difference(counts)
        total = 0
        if long_ := {u for u in new if len(u) > LONGEST_KEPT}:
            units, again = [u for u in units if u not in long_], Counter(u for u in units if u in long_)
            total = sum(self.count_unit(u) * n for u, n in again.items())
            new -= long_
        size = sum(map(len, new))
        if len(counts) + len(new) > KEEP_UNITS or self.kept + size > KEEP_CHARS:
            self.older, self.counts = counts, {}
            counts = self.counts
            self.kept, new = 0, set(units)
            size = sum(map(len, new))
        self.kept += size
        older = self.older
        for u in new:
            n = older.get(u)
            counts[u] = self.count_unit(u) if n is None else n
        return total + sum(map(counts.__getitem__, units))

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        maps = prefix_scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)], self)
        return maps[-1].close(self)

    def chunk_map(self, chunk: str) -> ChunkMap:
        first = WHITE.search(chunk)
        if first is None:
            return ChunkMap([chunk], None, [])
        end = max(chunk.rfind(" "), chunk.rfind("\n"), first.start())
        return ChunkMap([chunk[: first.start()]], self.count_units(chunk[first.start() : end].replace("\n", " ").split(" ")), [chunk[end:]])


@dataclass
class ChunkMap:
    """What a chunk does: an open head, tokens emitted behind it (None: no white space yet), an open tail."""

    head: list[str]
    inner: int | None
    tail: list[str]

    def then(self, other: ChunkMap, machine: CountingTransducer) -> ChunkMap:
        if self.inner is None:
            return ChunkMap(self.head + other.head, other.inner, other.tail)
        if other.inner is None:
            return ChunkMap(self.head, self.inner, self.tail + other.head)
        seam = machine.count_units("".join(self.tail + other.head).replace("\n", " ").split(" "))
        return ChunkMap(self.head, self.inner + seam + other.inner, other.tail)

    def close(self, machine: CountingTransducer) -> int:
        """Tokens when a text begins and ends with this chunk."""
        ends = ["".join(self.head + self.tail)] if self.inner is None else ["".join(self.head), "".join(self.tail)]
        return (self.inner or 0) + sum(machine.count_units(e.replace("\n", " ").split(" ")) for e in ends)


def prefix_scan(maps: list[ChunkMap], machine: CountingTransducer) -> list[ChunkMap]:
    """All prefixes' maps in logarithmically many rounds: pairs, their scan, then the odd places."""
    if len(maps) < 2:
        return maps
    pairs = prefix_scan([a.then(b, machine) for a, b in zip(maps[::2], maps[1::2])], machine)
    return [maps[0]] + [pairs[i // 2] if i % 2 else pairs[i // 2 - 1].then(maps[i], machine) for i in range(1, len(maps))]


@lru_cache(maxsize=2)
def transducer(path: str) -> CountingTransducer:
    return CountingTransducer(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit), a row for each row of docs."""
    rows = docs.select(*(F.col(f"`{k}`") for k in keep), F.coalesce(F.octet_length(F.col(f"`{text_col}`")).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*(f for f in rows.schema if f.name != "__text"), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]):
        machine = transducer(path)
        for batch in batches:
            texts = batch.column("__text")
            yield {n: batch.column(n) for n in schema.names[:-1]} | {"n_tokens": [machine.count(t.as_py()) for t in texts]}

    return map_arrow(rows, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
