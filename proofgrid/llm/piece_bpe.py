"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A sequence of pieces is what merging would give if and only if every piece merges
back to itself and every two neighbours, merged afresh, stay apart. So a text is
encoded from the left with the longest piece that an Aho-Corasick automaton finds,
checking only neighbours; where none fits, the position goes into a field of failed
positions and the last piece is shortened. No merge queue over the text is needed.

Pieces of the vocabularies supported never hold a space mark behind another
character, so a text falls apart before every run of spaces; this is verified when a
model is loaded, and otherwise lines are encoded whole. Results of such units are
kept in a bounded table. A unit also falls apart before its closing stops if no piece
holds the two characters that meet there.

Defined results: a null or empty text gives only begin and end; characters outside
the vocabulary give their byte pieces; ties between equal scores go to the left.
Extra columns pass through untouched; a text of any length is handled whole.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow
from .merge_rules import Seams

MARK = "▁"
TAIL = ",.;:!?"
#: Units and their characters that a worker keeps of each of two generations, and closing stops; longer units are not kept.
KEEP, KEEP_CHARS, KEEP_TAILS, LONGEST_KEPT = 150_000, 3_000_000, 10_000, 64


codecs.register_error("one_byte", lambda e: ("�", e.start + 1))


class PieceCodec:
    """Encodes and decodes with the pieces and scores of one model file."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        byte = [model.IsByte(i) for i in range(n)]
        special = [model.IsControl(i) or model.IsUnknown(i) or model.IsUnused(i) for i in range(n)]
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.ids = {p: i for i, p in enumerate(pieces) if not (byte[i] or special[i])}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if byte[i]}
        self.surface = [bytes([int(p[3:5], 16)]) if byte[i] else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        if self.unk >= 0:
            self.surface[self.unk] = " ⁇ ".encode()
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.stops = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1) if p[k + 1] in TAIL}
        self.by_line = not any("\n" in p for p in self.ids)
        ranks = {p: -s for p, s in self.score.items()}
        self.seams = Seams(lambda x, y: ranks.get(x + y))
        self.find = ahocorasick.Automaton()
        for p in filter(self.own, self.ids):
            self.find.add_word(p, (len(p) - 1, p))
        self.find.make_automaton()
        self.longest = max(map(len, self.ids))
        self.shorter: dict[str, str | None] = {}
        self.newline = array("I", [self.byte_ids.get(10, self.unk)]).tobytes()
        # packed ids of units: the older generation goes when the younger is full; what is met again passes to the younger
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.kept = 0

    def own(self, piece: str) -> bool:
        """Merging a piece's characters gives the piece."""
        return self.seams.edges(piece) is not None

    def next_shorter(self, piece: str) -> str | None:
        """The longest shorter piece with which this one begins."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids and self.own(piece[:k])), None)
        return self.shorter[piece]

    def segment(self, text: str) -> list[int]:
        """Ids of a text with its space marks in place, by backtracking."""
        longest: dict[int, str] = {}
        for end, (back, piece) in self.find.iter(text):
            longest[end - back] = piece  # ends only grow, so the last one is the longest
        if len(longest) == len(text):
            return [*map(self.ids.__getitem__, self._run(0, len(text), longest))]
        out: list[int] = []
        n, pos = len(text), 0
        while pos < n:
            if pos not in longest:
                out += [self.byte_ids.get(b, self.unk) for b in text[pos].encode("utf-8", "surrogatepass")]
                pos += 1
                continue
            end = pos
            while end in longest:  # unknown characters can't be merged over
                end += 1
            out += [self.ids[p] for p in self._run(pos, end, longest)]
            pos = end
        return out

    def _run(self, start: int, end: int, longest: dict[int, str]) -> list[str]:
        failed, apart = bytearray((end - start) // 8 + 1), self.seams.apart
        known, shorter = self.seams.known, self.shorter
        out: list[str] = []
        pos, piece, last = start, longest[start], None
        while True:
            stop = pos + len(piece)
            at = stop - start
            if not failed[at >> 3] >> (at & 7) & 1:
                fits = last is None or known.get((last, piece))
                if fits or fits is None and apart(last, piece):
                    out.append(piece)
                    if stop == end:
                        return out
                    pos, last, piece = stop, piece, longest[stop]
                    continue
            short = shorter[piece] if piece in shorter else self.next_shorter(piece)
            while short is None:
                if not out:
                    raise ValueError("no segmentation; the vocabulary lacks a single character")
                at = pos - start
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                pos -= len(piece)
                last = out[-1] if out else None
                short = self.next_shorter(piece)
            piece = short

    def _pack(self, text: str) -> bytes:
        return array("I", self.segment(text)).tobytes()

    def _codes(self, units: list[str]) -> list[bytes]:
        """Packed ids of units: "\\n..." is what it is, any other has a space in front."""
        known = self.known
        new = set(units).difference(known)
        long_ = {u: self._unit(u) for u in new if len(u) > LONGEST_KEPT}
        new.difference_update(long_)
        size = sum(map(len, new))
        if len(known) + len(new) > KEEP or self.kept + size > KEEP_CHARS:
            self.older, self.known = known, {}
            known = self.known
            self.kept = 0
            new = {u for u in units if u not in long_}
            size = sum(map(len, new))
        self.kept += size
        older = self.older
        for u in new:
            got = older.get(u)
            known[u] = self._unit(u) if got is None else got
        if not long_:
            return [*map(known.__getitem__, units)]
        return [long_[u] if u in long_ else known[u] for u in units]

    def _unit(self, unit: str) -> bytes:
        core = unit.rstrip(TAIL)
        k = len(core)
        if not core or k == len(unit) or unit[0] == "\n" and k == 1 or unit[k - 1 : k + 1] in self.stops:
            return self._whole(unit)
        got = self.known.get(core)
        if got is None:
            got = self.older.get(core)
            got = self._whole(core) if got is None else got
            if k <= LONGEST_KEPT:
                self.known[core] = got
                self.kept += k
        tail = self.tails.get(unit[k:])
        if tail is None:
            if len(self.tails) > KEEP_TAILS:
                self.tails.clear()
            tail = self._pack(unit[k:])
            if len(unit) - k <= LONGEST_KEPT:
                self.tails[unit[k:]] = tail
        return got + tail

    def _whole(self, unit: str) -> bytes:
        return self._pack(MARK + unit) if unit[0] != "\n" else self.newline + self._pack(unit[1:]) if len(unit) > 1 else self.newline

    def encode(self, text: str | None, begin: bool = True, end: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = [array("I", [self.bos]).tobytes()] if begin else []
        if text and self.by_word and self.by_line and text[0] not in " \n" and text[-1] != " " and not any(x in text for x in (MARK, "  ", " \n")):
            out += self._codes(text.replace("\n", " \n").split(" "))
        elif text:
            for k, line in enumerate(text.split("\n") if self.by_line else [text]):
                if not k and text[0] == "\n":
                    out.append(self._pack(MARK))
                elif not line:
                    out.append(self.newline)
                elif not self.by_word or MARK in line or "  " in line or line[-1] == " ":
                    if k:
                        out.append(self.newline)
                    marked = MARK * (not k) + line.replace(" ", MARK)
                    for unit in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked) if self.by_word else [marked]:
                        out.append(self._pack(unit))
                else:
                    units = line.split(" ")
                    if k:
                        units[0] = "\n" + units[0]
                    elif not units[0]:
                        out.append(self._pack(MARK + MARK + units[1]))
                        del units[:2]
                    out += self._codes(units)
        if end:
            out.append(array("I", [self.eos]).tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; the space that encoding puts in front goes."""
        values = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.surface.__getitem__, values))
        first = next((i for i in values if self.surface[i]), None)
        if first is not None and first != self.unk and raw[:1] == b" " and first not in self.byte_ids.values():
            raw = raw[1:]
        return raw.decode("utf-8", "one_byte")


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", begin: bool = True, end: bool = True, decoded: bool = False) -> DataFrame:
    """docs with ``ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and, on request, ``decoded``.

    Columns of docs with these names are replaced; all others pass through.
    """
    keep = [f for f in docs.schema if f.name not in ("ids", "n_tokens", "decoded")]
    names = [f.name for f in keep]
    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())] + [T.StructField("decoded", T.StringType())] * decoded
    rows = docs.select(*(f"`{n}`" for n in names), docs[f"`{text_col}`"].alias("__text")) if text_col not in names else docs.select(*(f"`{n}`" for n in names))
    source = text_col if text_col in names else "__text"

    def run(batches: Iterator[pa.RecordBatch]):
        c = codec(model_path)
        for batch in batches:
            texts = batch.column(source)
            step = 512
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids = [c.encode(t.as_py(), begin, end) for t in texts.slice(lo, step)]
                out = {n: part.column(n) for n in names}
                out |= {"ids": pa.array(ids, pa.binary()), "n_tokens": [len(x) // 4 for x in ids]}
                if decoded:
                    out["decoded"] = [c.decode(x) for x in ids]
                yield out

    return map_arrow(rows, run, T.StructType(keep + added))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of packed ids in out_col; null ids give null."""
    keep = [f for f in rows.schema if f.name != out_col]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]):
        c = codec(model_path)
        for batch in batches:
            texts = [None if (x := v.as_py()) is None else c.decode(x) for v in batch.column(ids_col)]
            yield {n: batch.column(n) for n in names} | {out_col: texts}

    return map_arrow(rows.select(*(f"`{n}`" for n in names)), run, T.StructType([*keep, T.StructField(out_col, T.StringType())]))
