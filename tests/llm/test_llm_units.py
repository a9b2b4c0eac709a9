"""The operators' kernels against the libraries and brute force, without Spark."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from proofgrid.llm import hnsw_dedup, html_wrapper, lang_centroid, odd_sketch, permutation_index, piece_bpe, pivotal_mix, token_transducer, url_cascade

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abeinrst  \n▁éß中🙂'.0123THEΣ<>x\t\x00​"


def samples(seed, n, size=40, alphabet=ALPHABET):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_piece_codec_is_exact():
    own, library = piece_bpe.codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["", " ", "▁a", "x" * 3000, "\n\n", *(" " * k + "the" + " " * k for k in range(40)), *samples(1, 3000), *samples(2, 500, 60, "abcdefghilmnoprstu")]
    texts += [library.id_to_piece(i) for i in range(1, 32000, 61)]
    for t in texts:
        want = library.encode(t, add_bos=True, add_eos=True)
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, t
        assert own.decode(got) == library.decode(want), t


def test_decoding_of_broken_bytes():
    own, library = piece_bpe.codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(6)]
        first = [1, 262, *ids]
        assert own.decode(np.array(first, "<u4").tobytes()) == library.decode(first)


def test_token_counts_are_exact():
    own, library = token_transducer.transducer(WORDS), Tokenizer.from_file(WORDS)
    texts = [*samples(4, 3000), *(t + "<|endoftext|>" + t for t in samples(5, 200)), *samples(6, 500, 60, "abcdefghilmnoprstu"), "I'll don't we've he's", "ꟋꟜ"]
    for t in texts:
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert own.count(t) == want, t
        assert own.count(t, chunk=5) == want, t
    assert own.count(None) == 0


def test_prefix_scan_gives_every_prefix():
    own = token_transducer.transducer(WORDS)
    text = "some words, and others; " * 20
    maps = [own.chunk_map(text[i : i + 7]) for i in range(0, len(text), 7)]
    for k, m in enumerate(token_transducer.prefix_scan(maps, own)):
        assert m.close(own) == own.count(text[: 7 * (k + 1)])


def test_shingles_and_sketches():
    assert len(odd_sketch.shingles("a b a b a", 2)) == 2 and len(odd_sketch.shingles("one", 2)) == 1 and not len(odd_sketch.shingles(" \n", 2))
    assert (odd_sketch.shingles("A b", 2) == odd_sketch.shingles("a\tB", 2)).all()
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    far = []
    for _ in range(200):
        other = base.copy()
        other[:44] = rng.integers(0, 1 << 62, 44)  # similarity 356 / 444 = 0.80
        a, b = (odd_sketch.sketch(odd_sketch.minhash(x, odd_sketch.BANDS * odd_sketch.ROWS)) for x in (base, other))
        far.append(int(np.bitwise_count(a ^ b).sum()))
    assert max(far) <= odd_sketch.sketch_limit(80)
    a, b = (odd_sketch.sketch(odd_sketch.minhash(rng.integers(0, 1 << 62, 400).astype(np.uint64), 180)) for _ in range(2))
    assert int(np.bitwise_count(a ^ b).sum()) > odd_sketch.sketch_limit(80)


def test_settling_keeps_words_and_rounds():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        size, p = rng.integers(1, 500, n), rng.random(n)
        mass = float((size * p).sum())
        ids = np.arange(n)
        held = pivotal_mix.settle(ids, size, p, 7)
        assert ((p == 0) | (p == 1) | (np.arange(n) == held)).all() and abs(float((size * p).sum()) - mass) < 1e-3


def test_settling_keeps_expectations():
    total = np.zeros(6)
    for seed in range(3000):
        p = np.array([0.2, 0.7, 0.5, 0.4, 0.9, 0.3])
        held = pivotal_mix.settle(np.arange(6), np.array([50, 40, 30, 20, 10, 5]), p, seed)
        total += p
        assert held < 0 or 0 < p[held] < 1
    assert np.abs(total / 3000 - [0.2, 0.7, 0.5, 0.4, 0.9, 0.3]).max() < 0.05


def test_cascade_levels_are_exact():
    rng = np.random.default_rng(2)
    listed = rng.integers(-(1 << 62), 1 << 62, 500)
    level = url_cascade.Level.of(listed, 0.01, 0)
    assert level.holds(listed, 0).all()
    assert url_cascade.Level.of(listed, 0.01, 0).holds(rng.integers(-(1 << 62), 1 << 62, 5000), 0).mean() < 0.05
    assert not url_cascade.Cascade().listed(listed).any()


def test_wrappers():
    page = lambda k, extra="": f"<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li>a{k}</li><li>b</li></ul></nav>{extra}<article><h1>Title {k}</h1><p>One &amp; <b>two</b>\n three<p>four {k}<br>five<section class=comments><p>me too</p></section></article><footer>f</footer>"
    whole = None
    for k in range(5):
        e = html_wrapper.fold(html_wrapper.read_page(page(k, "<div class='cookie-notice'><p>take care</p></div>" if k % 2 else "")))
        whole = e if whole is None else html_wrapper.align(whole, e)
    w = html_wrapper.Wrapper(whole)
    for k in range(5):
        assert w.texts(html_wrapper.read_page(page(k))) == [f"Title {k}", "One & two three", f"four {k} five"]
    assert html_wrapper.Wrapper(html_wrapper.fold(html_wrapper.read_page(None))).texts(html_wrapper.read_page("")) == []
    plain = html_wrapper.fold(html_wrapper.read_page("<div class=menu>x</div><p>some running text here</p><form>y</form>"))
    assert html_wrapper.Wrapper(plain).texts(html_wrapper.read_page("<div class=menu>x</div><p>some running text here</p><form>y</form>")) == ["some running text here"]
    deep = "<div>" * 5000 + "x"
    assert html_wrapper.read_page(deep)


def wrapper_of(pages):
    whole = None
    for page in pages:
        e = html_wrapper.fold(html_wrapper.read_page(page))
        whole = e if whole is None else html_wrapper.align(whole, e)
    return html_wrapper.Wrapper(whole)


def test_slots_decide_inside_a_region():
    pages = [f"<article><h1>Same</h1><div>Read our terms, they are the same everywhere</div><p>text {k}<ul><li><a>more {k}</a></ul></article>" for k in range(5)]
    w = wrapper_of(pages)
    assert [w.texts(html_wrapper.read_page(p)) for p in pages] == [["Same", f"text {k}"] for k in range(5)]
    copies = ["<article><h1>Same</h1><p>nothing differs here</article>"] * 5
    assert wrapper_of(copies).texts(html_wrapper.read_page(copies[0])) == ["Same", "nothing differs here"]


def test_each_page_has_a_region_of_its_own():
    pages = [f"<article><p>text {k}</article>" for k in range(5)] + ["<main><p>in main</main><div>out</div>", "<div class=content><p>in content</div><div>out</div>", "<nav>menu</nav><p>running text without any region</p>"]
    w = wrapper_of(pages)
    assert [w.texts(html_wrapper.read_page(p)) for p in pages[5:]] == [["in main"], ["in content"], ["running text without any region"]]
    assert w.texts(html_wrapper.read_page(pages[0])) == ["text 0"]


def test_inverted_files_give_footrule():
    rng = np.random.default_rng(3)
    lists = np.array([rng.permutation(12)[:5] for _ in range(40)])
    files = permutation_index.InvertedFiles(lists, 12)
    for q in lists[:10]:
        want = []
        for x in lists:
            place = lambda v, p: list(v).index(p) if p in v else 5
            want.append(sum(abs(place(q, p) - place(x, p)) for p in range(12)))
        assert files.footrule(q).tolist() == want


def test_copies_do_not_crowd_the_rerank():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 16))
    x[rng.permutation(2000)[:900]] = x[0]
    pivots = x[np.unique(x, axis=0, return_index=True)[1][:64]]
    lists = permutation_index.permutations(x, pivots, 16)
    table = pa.table({"id": pa.array(range(2000)), "vector": pa.array(list(x), pa.list_(pa.float64())), "pivots": pa.array(list(lists), pa.list_(pa.int16()))})
    copies = np.flatnonzero((x == x[0]).all(axis=1))
    q = copies[[0, 5, 25, -1]]
    got = permutation_index._search(table, table.take(q), 20, 64, 0.2, 256)
    for i in q:
        at = got["query_id"] == i
        s = x @ x[i]
        s[copies], s[i] = s[copies[0]], -np.inf
        assert got["vec_id"][at].tolist() == np.lexsort((np.arange(2000), -s))[:20].tolist()


def test_graphs_find_all_near_vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[700:1000] = x[0] + 0.05 * rng.normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order = rng.permutation(len(x))
    graph = hnsw_dedup.Graph.build(x[order])
    hits = hnsw_dedup.audited_search(graph, x, np.arange(0, 1500, 10), 0.9)
    missed = wanted = 0
    for h, s in zip(hits, x @ x[order].T):
        truth = set(np.flatnonzero(s >= 0.9))
        assert set(h) <= truth
        missed, wanted = missed + len(truth - set(h)), wanted + len(truth)
    assert missed <= 0.0005 * wanted


def test_audit_weighs_small_groups():
    unit = np.repeat(np.eye(40), [1000] + [2] * 39, axis=0)

    class Blind:
        """A graph that finds small groups only with a wide beam."""

        x = unit

        def range_search(self, q, width, least):
            hits = [np.flatnonzero(s >= least) for s in q @ self.x.T]
            return [h if len(h) > 100 or width >= 256 else h[:1] for h in hits]

    Blind.unit = unit
    hits = hnsw_dedup.audited_search(Blind(), unit, np.arange(0, len(unit), 2), 0.9)
    assert [len(h) for h in hits] == [1000] * 1000 + [2] * 78


def test_ngram_counts():
    assert (lang_centroid.ngram_counts("ab, AB!") == lang_centroid.ngram_counts("ab ab")).all()
    assert lang_centroid.ngram_counts(None).sum() == lang_centroid.ngram_counts("").sum()
    with pytest.raises(ValueError):
        token_transducer.CountingTransducer(public_tokenizers.path("byte_bpe_50k.json"))


def test_frequent_units_outlive_a_full_table(monkeypatch):
    """What is met again and again is counted once, and a word once whatever stops stand behind it, however many rare units fill the table."""
    own, library = token_transducer.CountingTransducer(WORDS), Tokenizer.from_file(WORDS)
    monkeypatch.setattr(token_transducer, "KEEP_UNITS", 60)
    seen, walk = [], own.count_word
    monkeypatch.setattr(own, "count_word", lambda word: seen.append(word) or walk(word))
    texts = [f"frequent words, Frequent! {' '.join(f'rare{k}x{n}' for n in range(8))} words end" for k in range(60)]
    assert [own.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert seen.count("frequent") == 1 and seen.count("words") == 1
    assert max(len(own.counts), len(own.older), len(own.words_met), len(own.older_words)) <= 60


def test_frequent_pieces_outlive_a_full_table(monkeypatch):
    own, library = piece_bpe.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(piece_bpe, "KEEP", 60)
    seen, segment = [], own.segment
    monkeypatch.setattr(own, "segment", lambda text: seen.append(text) or segment(text))
    texts = [f"frequent words, frequent! {' '.join(f'rare{k}x{n}' for n in range(8))}\nlines begin,\nwords\n\n end" for k in range(60)]
    assert [np.frombuffer(own.encode(t), "<u4").tolist()[1:-1] for t in texts] == [library.encode(t) for t in texts]
    assert seen.count("▁frequent") == 1 and seen.count("▁words") == 1 and seen.count("lines") == 1 and seen.count("words") == 1
    assert max(len(own.known), len(own.older)) <= 66  # stems that stand before stops are added


def test_stops_behind_units():
    """Units are cut before their stops, and texts into units, only where no piece reaches across."""
    own, library = piece_bpe.PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pick = random.Random(3)
    bits = ["a", "word", "Word,", "x.", ".", ",", ";:", "!?", " ", "  ", "\n", "\n\n", " \n", "\n ", "▁", "é", "中", "1", "2,", "...", "\t", "\0", "s,", ").", "z" * 70 + ",", "." * 70]
    for _ in range(3000):
        text = "".join(pick.choices(bits, k=pick.randint(1, 14)))
        assert np.frombuffer(own.encode(text), "<u4").tolist()[1:-1] == library.encode(text), text
