"""Index searches against all pairs: nearest names, containment, keys named like helper columns."""

import random

import pytest
from pyspark.sql import functions as F

from proofgrid.functions.text import similarity
from proofgrid.operators import nearest, resolve
from proofgrid.storage import stage

PARTS = "ra lo mi ten gor vash eld quin ora thum bel sor ka".split()


def names(n, seed=1, words=(1, 3)):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 3)))
    return sorted({" ".join(word() for _ in range(rng.randint(*words))) for _ in range(n)})


def noisy(rng, s):
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(len(s) + 1)
        s = rng.choice([s[:k] + rng.choice("xyz") + s[k:], s[:k] + s[k + 1 :], s[:k] + "q" + s[k + 1 :]])
    return s


def test_matches_by_index_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    entries = names(400)
    texts = [noisy(rng, rng.choice(entries)) for _ in range(150)] + [None, "", "a", "ab", "rax", "!!", "zzzzzzzzzzzzzz", "x" * 60, entries[5] + " " + entries[9], entries[7][:6], "REPEATED", "repeated"]
    q = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "id int, t string, kind int")
    c = spark.createDataFrame([(e, k) for i, e in enumerate(entries) for k in range(3) if (i + k) % 4], "name string, kind int").repartition(3)
    for pool in (None, F.col("q_kind") == F.col("c_kind")):
        asked = q if pool is not None else q.select("id", "t")
        whole, index = ({r["id"]: tuple(r) for r in resolve.match(asked, c, "id", "t", "name", pool=pool, few=few).collect()} for few in (10_000, 0))
        assert len(whole) == len(texts) and whole == index


def test_each_round_finds_all_pairs_at_its_similarity(spark):
    rng = random.Random(3)
    entries = names(250, 5)
    q = spark.createDataFrame([(i, noisy(rng, rng.choice(entries)).replace(" ", "")) for i in range(120)], "qid int, query string")
    e = spark.createDataFrame([(i, x.replace(" ", "")) for i, x in enumerate(entries)], "eid int, norm string")
    far = F.levenshtein("query", "norm") * 100 <= (100 - F.lit(0)) * F.greatest(F.length("query"), F.length("norm"))
    every = q.where("query <> ''").join(e, far)
    for percent in (90, 70, 51):
        want = every.where(F.levenshtein("query", "norm") * 100 <= (100 - percent) * F.greatest(F.length("query"), F.length("norm")))
        got = nearest.near(q, e, percent)
        pairs = [tuple(r) for r in got.collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(r["qid"], r["eid"]) for r in want.collect()}, percent
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        nearest.near(q, e, 50)


def test_keys_and_grams_do_not_pass_through_the_driver(spark):
    """Small tables whose keys are many more rows than they have are shuffled, not broadcast."""
    q = stage(spark.createDataFrame([(i, x) for i, x in enumerate(names(50))], "qid int, query string"), "q")
    e = stage(spark.createDataFrame([(i, x) for i, x in enumerate(names(50, 2))], "eid int, norm string"), "e")
    for df in (nearest.near(q, e, 85), nearest.containing(q, e, "query", "norm")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_give_every_pair_that_may_be_among_the_two_best():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(5)
    entries = [x.replace(" ", "") for x in names(80)] + ["é中🙂", "a", "x" * 90]
    queries = [noisy(rng, rng.choice(entries)) for _ in range(40)] + ["b", "q" * 31, "rami" * 8, "tenlo" * 12 + "abc"]
    queries = [x for x in queries if 0 < len(x) <= nearest.BITS]
    i, j, alike, bound = nearest._nearest_in_block(queries, entries)
    got = {(a, b): s for a, b, s in zip(i.tolist(), j.tolist(), alike.tolist())}
    for a, q in enumerate(queries):
        want = [1 - distance(q, e) / max(len(q), len(e)) for e in entries]
        for b, s in enumerate(want):
            assert (a, b) not in got or got[a, b] == pytest.approx(s)
            assert s < sorted(want)[-2] or (a, b) in got


def test_blocks_measure_few_of_the_pairs(monkeypatch):
    """Common subsequences and bounds found elsewhere rule most pairs out, and none of the two nearest."""
    rng = random.Random(9)
    entries = [x.replace(" ", "") for x in names(3000, 4, (3, 4))]
    queries = [noisy(rng, rng.choice(entries))[:31] for _ in range(60)]
    measured = []
    monkeypatch.setattr(nearest, "_distances", lambda *a, of=nearest._distances: measured.append(len(a[4])) or of(*a))
    want = {}
    for a, b, s in zip(*nearest._nearest_in_block(queries, entries)[:3]):
        want.setdefault(int(a), {})[entries[b]] = s
    measured.clear()
    i, _, _, bound = nearest._nearest_in_block(queries, entries[: len(entries) // 2], whole=False)
    assert i.tolist() == list(range(len(queries))) and all(sorted(want[k].values())[-2] >= b - 1e-6 for k, b in zip(i.tolist(), bound.tolist()))
    got = {}
    for a, b, s in zip(*nearest._nearest_in_block(queries, entries, bound)[:3]):
        got.setdefault(int(a), {})[entries[b]] = s
    assert sum(measured) < 0.1 * len(queries) * len(entries)
    assert all(got[k] == want[k] for k in want)


def test_names_without_a_pool_meet_blocks_not_segments(spark, monkeypatch):
    """Short queries are not cut into keys of a few characters that very many entries share."""
    monkeypatch.setattr(nearest, "near", lambda *a: pytest.fail("segments of all entries"))
    monkeypatch.setattr(nearest, "BLOCK", 64)
    rng = random.Random(13)
    entries = names(600, 8)
    q = spark.createDataFrame([(i, noisy(rng, rng.choice(entries))) for i in range(150)], "id int, t string")
    c = spark.createDataFrame([(e,) for e in entries], "name string")
    whole, index = ({r["id"]: tuple(r) for r in resolve.match(q, c, "id", "t", "name", few=few).collect()} for few in (10_000, 0))
    assert len(whole) == 150 and whole == index


def test_few_entries_and_few_queries(spark):
    c = spark.createDataFrame([("granite hound",), ("granite hounds",)], "name string")
    q = spark.createDataFrame([(1, "granite houndz"), (2, "hound"), (3, "nothing alike")], "id int, t string")
    for catalog in (c, c.limit(1), c.limit(0)):
        whole, index = (sorted(map(tuple, resolve.match(q, catalog, "id", "t", "name", few=few).collect())) for few in (10, -1))
        assert whole == index


def test_containment_of_twenty_thousand_names(spark):
    every = names(26_000, 11, (1, 4))[:20_000]
    df = spark.createDataFrame([(n,) for n in every], "name string")
    got = resolve.collisions(df, "name")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = {tuple(r) for r in got.collect()}
    norm = {}
    for n in every:
        norm.setdefault(n.replace(" ", ""), []).append(n)
    want = set()
    for text, outers in norm.items():
        for k in range(len(text)):
            for end in range(k + 5, len(text) + 1):
                if end - k < len(text):
                    want |= {(a, b) for a in norm.get(text[k:end], ()) for b in outers}
    assert pairs == want and len(want) > 1000


def test_columns_named_like_helpers(spark):
    for key in ("k", "next", "before", "n", "s", "next_s"):
        samples = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.1, 0.9])], f"{key} int, v array<double>")
        templates = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [0.5, 0.499]), ("c", [0.9, 0.1])], "name string, t array<double>")
        r = {x[0]: x for x in resolve.rank_templates(samples, templates, key, "v", "name", "t").collect()}
        assert (r[1]["best"], r[1]["runner_up"]) == ("a", "b") and 0 < r[1]["margin"] < 0.003, key
        w = resolve.icon_warnings(samples, templates, key, "v", "name", "t").collect()
        assert [x["runner_up"] for x in w if x[0] == 1] == ["b"], key
    cand = spark.createDataFrame([(1, 0, "x", 0.5), (1, 1, "y", 0.8)], "k int, stage int, entry string, score float")
    assert [r["entry"] for r in resolve.cascade(cand, "k", "stage").collect()] == ["y"]
    q = spark.createDataFrame([(1, "granit")], "k int, t string")
    c = spark.createDataFrame([("granite",)], "name string")
    assert [r["entry"] for r in resolve.match(q, c, "k", "t", "name").collect()] == ["granite"]
    assert similarity is nearest.similarity
