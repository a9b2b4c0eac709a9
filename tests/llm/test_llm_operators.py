"""The operators on small hostile tables: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from proofgrid.llm import hnsw_dedup, html_wrapper, lang_centroid, odd_sketch, permutation_index, piece_bpe, pivotal_mix, token_transducer, url_cascade
from proofgrid.llm.graph import connected_components

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, rank int"


def docs(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "clash", "clash", 0) for i, t in enumerate(texts)], DOCS)


HOSTILE = [None, "", "   ", "one", "same words here again and again", "same words here again and again", "é" * 50_000, "word " * 30_000, "a\nb\tc", "12 34 !!"]


def test_piece_codec(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_bpe.encode(docs(spark, HOSTILE), PIECES, decoded=True)
    assert "lang" in got.columns and got.columns.count("ids") == 1
    for r in got.collect():
        want = library.encode(HOSTILE[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want) and r["decoded"] == library.decode(want)
    again = piece_bpe.decode(got.drop("decoded"), PIECES)
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {r["doc_id"]: r["decoded"] for r in got.collect()}
    assert piece_bpe.encode(docs(spark, []), PIECES).count() == 0


def test_token_counts(spark):
    library = Tokenizer.from_file(WORDS)
    got = token_transducer.count_tokens(docs(spark, HOSTILE), WORDS, limit=2048).collect()
    for r in got:
        t = HOSTILE[r["doc_id"]] or ""
        want = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), want, want > 2048)
    assert len(got) == len(HOSTILE) and token_transducer.count_tokens(docs(spark, []), WORDS).count() == 0


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    part = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    part[i] = part[j] = min(part[i], part[j])
    return sets, part


def test_near_duplicates(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary, 120).tolist() for _ in range(6)]
    texts = list(HOSTILE)
    for b in base:
        for k in range(14):
            t = list(b)
            for at in rng.integers(0, 120, k):
                t[at] = f"x{rng.integers(0, 1000)}"
            texts.append(" ".join(t))
        texts.append(" ".join(b).upper())
    for width in (2, 5):
        sets, want = brute_components(texts, width, 80)
        got = odd_sketch.near_duplicates(docs(spark, texts), width=width, percent=80).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, want))}
        assert len(got) == len(texts)
    assert odd_sketch.near_duplicates(docs(spark, [])).count() == 0
    assert [r["component_id"] for r in odd_sketch.near_duplicates(docs(spark, [None])).collect()] == [0]


def test_near_duplicates_of_repeated_ids(spark):
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "x y"), (5, "x y"), (None, "p q r"), (7, "p q r"), (8, None), (8, ""), (9, "m " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("clash")).withColumn("kept", F.lit("clash")).repartition(3)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"], r["n_shingles"]) for r in odd_sketch.near_duplicates(df, width=2).collect()), key=str)
    assert got == sorted([(1, 1, True, 3), (5, 1, False, 3), (5, 5, True, 1), (5, 5, True, 1), (None, 7, False, 2), (7, 7, True, 2), (8, 8, True, 0), (8, 8, True, 0), (9, 9, True, 1)], key=str)
    left = odd_sketch.drop_duplicates(df, width=2)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, "a b c d"), (5, "x y"), (7, "p q r"), (8, None), (8, ""), (9, "m " * 50_000)], key=str)
    assert odd_sketch.drop_duplicates(df.limit(0)).count() == 0


def test_frequent_keys_are_dealt_out(spark):
    from proofgrid.llm.common import join_frequent

    many = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"))
    one = spark.createDataFrame([(7, "hot"), (5, "five"), (6, "none")], "k long, v string")
    for how, rows in (("inner", 2502), ("left", 5000)):
        got = join_frequent(many, one, "k", "id", how=how, least=10, parts=8)
        assert got.count() == rows and got.where("v = 'hot'").count() == 2501 and got.where("v = 'five'").count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for local in (0, 1000):
        got = {r["v"]: r["component"] for r in connected_components(df, "a", "b", local).collect()}
        assert got == {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 140)}


def water_filling(size, weights, share, ceiling):
    """Targets by weight, those above their ceiling stopped and the rest shared again, round after round."""
    names = sorted((s for s in size if s is not None), key=lambda s: [*map(ord, s)]) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, goal, free = share * sum(size.values()), {}, set(names)
    while free:
        part = {s: (total - sum(goal.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if part[s] >= ceiling * size[s]}
        if not over:
            return goal | part
        goal |= {s: ceiling * size[s] for s in over}
        free -= over
    return goal


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), None if i % 5 == 0 else f"s{i % 4}") for i in range(900)] + [(900, None, "s1"), (901, " ", "s9"), (902, "w " * 30_000, "é"), (903, "x y", "Z"), (903, "x y", "Z"), (903, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for clash in ("copies", "source_size", "target", "size", "taken", "p", "grp"):
        df = df.withColumn(clash, F.lit("clash"))
    for weights, share in (((3, 1, 2), 1.5), ((1, 50), 1.2)):
        a, b = (sorted(map(tuple, pivotal_mix.mix(df.repartition(n), weights, share).collect()), key=repr) for n in (1, 5))
        assert a == b and len(a) == len(rows)
        size = {s: sum(r[1] for r in a if r[6] == s) for s in {r[6] for r in a}}
        goal = water_filling(size, weights, share, 2.0)
        assert all(r[2] == size[r[6]] and r[3] == pytest.approx(goal[r[6]]) and r[4] == r[1] * r[5] <= 2 * r[1] for r in a)
        most = {s: max(r[1] for r in a if r[6] == s) for s in size}
        for s in size:
            assert abs(sum(r[4] for r in a if r[6] == s) - goal[s]) <= most[s] / 2 + 1e-6
    assert pivotal_mix.mix(df).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert pivotal_mix.mix(df.limit(0)).count() == 0 and pivotal_mix.repeat(df.limit(0)).count() == 0


def test_mix_repeats_rows_of_one_id(spark):
    rows = [(7, "a b", "s"), (7, "a b", "s"), (7, "c d e f", "s"), (8, None, "s"), (9, "g", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("clash"))
    got = pivotal_mix.repeat(df)
    assert got.columns == df.columns
    taken = {c: sum(r[5] for r in pivotal_mix.mix(df).collect() if r[0] == c) for c in (7, 8, 9)}
    have = [r["doc_id"] for r in got.collect()]
    assert {c: have.count(c) for c in (7, 8, 9)} == taken and 0 < taken[7] <= 6


def test_urls(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    urls = ["http://A.Example.NET/en/x?q", "https://x.net", "http://x.net/", "x.org/fr/", None, "", "ftp://org/fr/1", "http://notexample.com/de/", "http://example.com/de/#a", "http://b.example.com/de/"] + [f"http://h{i}.net/p{i}" for i in range(300)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_cascade.judge(df, rules).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["example.net/en/", None, "net/", None, None, None, "org/fr/", None, "example.com/de/", "example.com/de/"]
    assert got[0]["host"] == "a.example.net" and got[0]["path"] == "/en/x" and got[4]["host"] == "" and got[1]["verdict"] == "allow"
    assert all(got[i]["rule"] == "net/" and got[i]["verdict"] == "block" for i in range(10, 310))
    assert url_cascade.judge(df.limit(0), rules).count() == 0 and {r["verdict"] for r in url_cascade.judge(df, {}).collect()} == {"allow"}


def test_pages(spark):
    page = "<body><nav>menu</nav><article><h1>T</h1><p>main {}</p></article><footer>f</footer>"
    rows = [(i, f"http://h{i % 3}.org/{i}", page.format(i), "clash") for i in range(20)] + [(20, None, None, ""), (21, "x", "", ""), (22, "http://h0.org/z", "<p>" + "x " * 100_000, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_wrapper.extract(df).collect()}
    assert all(got[i]["text"] == f"T\n\nmain {i}" and got[i]["n_chars"] == len(got[i]["text"]) for i in range(20)) and got[20]["text"] == got[21]["text"] == "" and len(got) == 23
    assert html_wrapper.extract(df.limit(0)).count() == 0


def test_pages_of_other_templates(spark):
    rows = [(i, "http://h0.org/%d" % i, f"<article><p>main {i}</p></article>") for i in range(5)] + [(5, "http://h0.org/z", "<p>" + "x " * 100_000), (6, None, "<article>a</article>"), (7, None, "<p>some running text of a page without host</p>")]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"main {i}" for i in range(5)} | {5: ("x " * 100_000).strip(), 6: "a", 7: "some running text of a page without host"}


def test_language(spark):
    words = {"aa": "ab ba aba bab abab", "bb": "xy yx xyx yxy xyxy", "cc": "ño ñañ oñ ñoo"}
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words[k].split(), 30)), k) for i in range(300) for k in [["aa", "bb", "cc"][i % 3]]] + [(300, None, "aa"), (301, "12 !", "bb"), (302, "", None), (303, "ab " * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in lang_centroid.identify(df, lang_centroid.fit(df, F.col("doc_id") % 3 < 3)).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 and not got[i]["rejected"] for i, _, k in rows[:300])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (300, 301, 302)) and got[303]["lang_pred"] == "aa"
    assert lang_centroid.fit(df.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in lang_centroid.identify(df, None).collect()} == {"und"}


def test_language_rejects_other_texts(spark):
    rng = np.random.default_rng(10)
    words = {k: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(150)] for k, letters in (("aa", "abdeilmnost"), ("bb", "aeghikorsuz"))}
    clean = [" ".join(rng.choice(words[k], n)) for n in (4, 12, 40, 150) for _ in range(60) for k in words]
    other = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), n)) for n in (100, 400, 1500)] + ["我们在这里讨论语言识别的问题" * n for n in (1, 20)] + ["все люди рождаются свободными и равными " * n for n in (1, 20)]
    rows = [(i, t, ["aa", "bb"][i % 2]) for i, t in enumerate(clean)] + [(1000 + i, t, None) for i, t in enumerate(other)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["rejected"] for r in lang_centroid.identify(df, lang_centroid.fit(df, F.col("doc_id") % 3 != 1)).collect()}
    assert not any(got[i] for i in range(len(clean))) and all(got[1000 + i] for i in range(len(other)))


VECTORS = "vec_id long, embedding array<float>, label int, score string"


def vectors(spark, x, bad=True):
    rows = [(i, [float(v) for v in r], 0, "clash") for i, r in enumerate(x)]
    n = len(rows)
    extra = [(n, None, 0, ""), (n + 1, [0.0] * x.shape[1], 0, ""), (n + 2, [float("nan")] * x.shape[1], 0, ""), (n + 3, [None] * x.shape[1], 0, ""), (n + 4, [], 0, "")]
    return spark.createDataFrame(rows + extra * bad, VECTORS)


def test_search(spark):
    x = np.random.default_rng(6).normal(size=(900, 16)).astype(np.float32)
    x[500:540] = x[40]  # ties
    got = permutation_index.search(vectors(spark, x), F.col("id") % 20 == 0, k=20).collect()
    s = x.astype(float) @ x.astype(float).T
    hit = 0
    for q in range(0, 900, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in {r["vec_id"] for r in mine}
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        assert all(r["score"] == pytest.approx(s[q, r["vec_id"]], abs=1e-9) for r in mine)
        best = [i for i in np.lexsort((np.arange(900), -s[q])) if i != q][:20]
        hit += len({r["vec_id"] for r in mine} & set(best))
    assert hit >= 0.9 * 45 * 20 and len(got) == 45 * 20
    few = permutation_index.search(vectors(spark, x[:5]), F.col("id") % 20 == 0, k=20).collect()
    assert len(few) == 4
    assert permutation_index.search(vectors(spark, x[:0].reshape(0, 16), False), F.col("id") % 20 == 0).count() == 0


def test_search_of_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (7, [1.0, 0.0, 0.0]), (20, None), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, query_id int")
    got = sorted((r["query_id"], r["vec_id"], r["score"]) for r in permutation_index.search(df, F.col("id") % 20 == 0, k=20).collect())
    assert got == [(0, 3, 1.0)] * 4 + [(40, 7, 1.0)]


def test_vector_duplicates(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[3] + 0.02 * rng.normal(size=(60, 16))
    x[200:204] = x[9] * 3
    got = {r["vec_id"]: r for r in hnsw_dedup.near_duplicates(vectors(spark, x)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(600, dtype=bool)
    part = np.arange(600)
    for _ in range(20):
        part = np.minimum(part, np.where(near, part[None, :], 600).min(axis=1))
    assert [got[i]["n_links"] for i in range(600)] == near.sum(axis=1).tolist() and [got[i]["component_id"] for i in range(600)] == part.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(600, 605)) and len(got) == 605
    assert hnsw_dedup.near_duplicates(vectors(spark, x[:0].reshape(0, 16), False)).count() == 0


def test_vector_duplicates_of_repeated_ids_and_lengths(spark):
    rows = [(1, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [3.0, 0.1, 0.0]), (5, [0.0, 1.0]), (8, []), (8, None), (9, [1e300, 1e-300])]
    got = hnsw_dedup.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, mult int")).collect()
    want = [(1, 2, 1, True), (5, 2, 1, False), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 6, False), (5, 1, 5, True), (8, 0, 8, True), (8, 0, 8, True), (9, 2, 1, False)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice([f"word{k}" for k in range(300)], 40)), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(120 + i, rows[i][1], "en", "s0", 0) for i in range(30)] + [(150, None, "en", "s1", 0), (151, "123", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert ids and max(ids) < 120 and all(r["round_trip"] for r in got)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(r["n_tokens"] == len(library.encode(rows[r["doc_id"]][1], add_bos=True, add_eos=True)) for r in got)
    size, taken = sum(len(r[1].split()) for r in rows[:120]), sum(len(rows[r["doc_id"]][1].split()) for r in got)
    assert abs(taken - 1.5 * size) <= 3 * 40


def test_digests(spark):
    sha = hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest()
    row = piece_bpe.encode(docs(spark, [""]), PIECES).select(F.sha2("ids", 256).alias("x")).first()
    assert row["x"] == sha
