"""Alignments against the tokenizer libraries and plain loops."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from proofgrid.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row string, kept string, n_a string, groups string, cut string"
HOSTILE = [
    None, "", " ", "\n", "one", "One, two. Three!", "same words here again", "same words here again", "  two  spaces  ", "\n\nlines\n\n\nmore\n", "a \nb\n c \n d", "tab\there\x0bthere", "nb\xa0sp 　wide", "mark ▁ inside", "<s> </s> <|endoftext|> <unk>",
    "it's they'll I'D we've", "1234567 89,000.50", "ünï ça Straße 中文字符 日本語 🙂👩‍👩‍👧", "a\x00b\x1cc\x85d e", "é" * 30_000, "word " * 20_000, "x" * 5_000, "!?;: ...", "end space ", "nl \n", "İstanbul ǅ ͸ \U000e0001", " lead", "don't.stop,now;ok", "é ñ",
]


def byte_of():
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(texts):
    library, pieces, table = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    library.encode_special_tokens = True
    names = {i: t for t, i in library.get_vocab().items()}
    each = []
    for text in texts:
        a, b = ([], []) if not text else (library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text))
        x = [bytes(table[c] for c in names[i]) for i in a]
        y = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in b)]
        raw = (" " + (text or "")).encode()
        if b"".join(x) != raw or b"".join(y) != raw:
            each.append(([], [], [], []))
            continue
        ends = [[*accumulate(map(len, s))] for s in (x, y)]
        cuts, groups, links, i, j = sorted(set(ends[0]) & set(ends[1])), [], [], 0, 0
        for c in cuts:
            to = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
            groups.append(",".join(map(str, a[i : to[0]])) + "|" + ",".join(map(str, b[j : to[1]])))
            links.append((a[to[0] - 1], b[to[1] - 1]))
            i, j = to
        each.append((a, b, groups, links))
    count = Counter(x for e in each for x in e[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), ";".join(g)) for a, b, g, x in each]


def table(spark, texts):
    return spark.createDataFrame([(i, t, *["clash"] * 5) for i, t in enumerate(texts)], SCHEMA)


def test_alignment(spark):
    want = brute(HOSTILE)
    for hot in (1, 200_000):  # all groups by the shuffle, and frequent ones broadcast
        got = {r["doc_id"]: r for r in token_alignment.align(table(spark, HOSTILE).repartition(3), A, B, hot=hot).collect()}
        assert len(got) == len(HOSTILE)
        for i, w in enumerate(want):
            r = got[i]
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == w, HOSTILE[i][:50]
            assert (r["row"], r["kept"], r["cut"]) == ("clash", "clash", "clash")
    digests = token_alignment.align(table(spark, HOSTILE), A, B, digest=True)
    assert "groups" in digests.columns  # of docs itself
    assert {r["doc_id"]: r["groups_sha256"] for r in digests.collect()} == {i: hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "" for i, w in enumerate(want)}


def test_small_blocks_and_tables(spark, monkeypatch):
    texts = [f"Some {w} words, and {w}s.\nThen {w}!" for w in ("blue", "red", "green", "ünder", "中文")] * 5
    pair = token_alignment.TokenPair(A, B)
    monkeypatch.setattr(token_alignment, "KEEP", 7)
    ids = lambda block, at, side: [b"".join(block[k][side] for k in numbers) for numbers in at]
    whole = [pair.whole(t) for t in texts]
    for size in (1, 3, 25):
        for lo in range(0, len(texts), size):
            tokens, at = pair.block(texts[lo : lo + size])
            assert [*zip(ids(tokens, at, 0), ids(tokens, at, 1))] == whole[lo : lo + size]
            assert len(pair.often) <= 7 and len(pair.once) <= 7


def test_every_character(spark):
    """Cutting into units, and splitting by the pattern, agree with the libraries around every character."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    pair = token_alignment.TokenPair(A, B)
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    lines = ["".join(f"a{c}b {c} {c}c1{c}, x.{c} " for c in chars[k : k + 64]) for k in range(0, 0x3400, 64)] + ["".join(f"a{c}b {c}, " for c in chars[k : k + 512]) for k in range(0x3400, len(chars), 5120)]
    for text, enc in zip(lines, library.encode_batch([" " + x for x in lines], add_special_tokens=False)):
        assert pair.bytes_a.encode_ordinary(" " + text) == enc.ids
    tokens, at = pair.block(lines)
    for text, numbers in zip(lines, at):
        got = pair.whole(text)
        assert (b"".join(tokens[k][0] for k in numbers), b"".join(tokens[k][1] for k in numbers)) == (got or (b"", b""))


def test_no_rows(spark):
    assert token_alignment.align(table(spark, []), A, B).count() == 0
    only = spark.createDataFrame([("a b",), (None,), ("a b",)], "text string")
    assert sorted(r["n_links"] for r in token_alignment.align(only, A, B).collect()) == [0, 2, 2]


def test_each_unit_is_tokenised_once(spark, monkeypatch):
    """Tokens are made of the corpus's distinct units, not of those of each block of texts."""
    texts = [*HOSTILE, *(f"The {w} house, the {w} house.\nA {w}" for w in ("blue", "red", "green")) , "The blue house"] * 3
    seen, tokenise = [], token_alignment.tokenise
    monkeypatch.setattr(token_alignment, "tokenise", lambda docs, *a, **b: seen.append(docs.select("text")) or tokenise(docs, *a, **b))
    monkeypatch.setattr(token_alignment, "discard", lambda *tables: None)
    monkeypatch.setattr(token_alignment, "STRETCH", 100)
    monkeypatch.setattr(token_alignment, "FLUSH", 5)
    want = brute(texts)
    for heavy, hot in ((0, 1), (3, 10), (1000, 1000)):  # all units by the shuffle, some, and none
        got = {r["doc_id"]: r for r in token_alignment.align(table(spark, texts).repartition(3), A, B, hot=hot, heavy=heavy).collect()}
        for i, w in enumerate(want):
            r = got[i]
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) == w, texts[i]
        units = [r["text"] for r in seen.pop().collect()]
        assert len(units) == len({*units}) and units.count("blue") == 1


def test_units_of_many_texts():
    pair = token_alignment.TokenPair(A, B)
    want = [[] if not t else ["▁" + t] if pair.split(t) is None else pair.split(t) for t in HOSTILE]
    for lo, hi in ((0, len(HOSTILE)), (4, 8), (5, 6)):
        sizes, units = pair.units(pa.array(HOSTILE, pa.string()).slice(lo, hi - lo))
        assert sizes.tolist() == [*map(len, want[lo:hi])] and units.to_pylist() == sum(want[lo:hi], [])
    for numbers in ([], [0], [5, -1, 1 << 20, -70_000]):
        assert token_alignment._unfolded(token_alignment._folded(np.array(numbers, np.int64))).tolist() == numbers


def local_run(monkeypatch, step, *args):
    """What a step does in a task, over batches that are handed to it here."""
    with monkeypatch.context() as m:
        m.setattr(token_alignment, "map_arrow", lambda rows, run, schema: run)
        return step(*args)


def test_workers_give_back_their_tables(spark, monkeypatch):
    """A worker's tables end with their task, and frequent units are no Python objects: both filled executors."""
    docs = table(spark, []).select("doc_id", "text")
    run = local_run(monkeypatch, token_alignment.tokenise, docs, A, B)
    batch = pa.RecordBatch.from_pydict({"kept": pa.array([{"doc_id": k} for k in range(3)]), "text": ["Some words, some words.", "other words here", None]})
    assert len([*run(iter([batch, batch]))]) == 2
    pair = token_alignment.token_pair(A, B)
    assert not pair.often and not pair.once

    n = 200_000
    heavy = pa.table({"groups": [f"{k},{k}|{k}" for k in range(n)]})
    schema = "kept struct<doc_id: long>, at binary, own array<string>, " + ", ".join(f"{s} long" for s in token_alignment.SUMS)
    run = local_run(monkeypatch, token_alignment.joined_groups, spark.createDataFrame([], schema), heavy, False)
    monkeypatch.setattr(token_alignment, "JOINED", 4, raising=False)
    at = [[0, -1, -2, -1, n - 1], [1, 1], [], [-1]]
    own = [["1 a b|c", "0 "], None, None, ["0 x|y"]]
    batch = {"kept": pa.array([{"doc_id": k} for k in range(4)]), "at": [token_alignment._folded(np.array(x, np.int64)) for x in at], "own": pa.array(own, pa.list_(pa.string()))}
    batch = pa.RecordBatch.from_pydict(batch | {s: [1, 2, 3, 4] for s in token_alignment.SUMS})
    tracemalloc.start()
    out = [*run(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    shown = [x for part in out for x in pa.array(part["shown"]).to_pylist()]
    assert shown == [f"0,0|0;;a b|c;;{n - 1},{n - 1}|{n - 1}", "1,1|1;1,1|1", "", "x|y"]
    assert peak < 12_000_000  # the broadcast itself takes 7
