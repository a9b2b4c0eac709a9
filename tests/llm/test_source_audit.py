"""Divergences against plain counting on small hostile tables."""

import re
from collections import Counter, defaultdict

from proofgrid.llm import source_audit

SCHEMA = "doc_id long, text string, lang string, source string, n long, value string, rank string, item string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "clash", "clash", "clash") for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def brute(rows, least, top):
    holds, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        holds[lang].update(set(terms))
        seen[lang, source].update(terms)
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in holds[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(seen[lang, s]) for s in sources}
        q = share(sum((seen[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s], "term": [(t, f(p[s][t], q[t])) for t in kept if seen[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1) if part == "pair" or k <= top}
    return out


def check(spark, rows, least, top=3, parts=3):
    got = source_audit.audit(table(spark, rows).repartition(parts), least=least, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and [t for _, t in got.dtypes][-2:] == ["bigint", "int"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, least, top)
    return found


HOSTILE = [
    ("The cat, the CAT and Ünder ünder Ünder", "en", "a"), ("the cat\x00sat on`the[mat", "en", "b"), ("dog dog dog the 中文字 中文字", "en", "c"), (None, "en", "d"), ("", "en", None),
    ("the cat", "en", "a"), ("the cat", "en", "a"), ("nur hier", "de", "a"), ("nur hier", "de", "b"), ("ganz allein", "fr", "z"), (None, None, None), ("12 34 !!", None, "x"), ("cat " * 60_000, "en", "long"), ("q1w2e3", "en", "\U0001f600"), ("q w", "en", "￿"),
]


def test_against_counting(spark):
    for least in (1, 2, 5):
        check(spark, HOSTILE, least)


def test_one_language_and_source_hold_most_rows(spark):
    rows = [(f"w{chr(97 + i % 26)} x{chr(97 + i % 7)} common", "en", f"s{i % 3 if i % 2 else 0}") for i in range(900)] + [("common words", "de", "s0")] * 11
    check(spark, rows, 10, parts=7)


def test_no_kept_terms_and_no_rows(spark):
    found = check(spark, [("a b", "en", "x"), ("c", "en", "y"), ("d", "en", "z")], 10)
    assert {r[2] for r in found} == {"pair"} and {r[4] for r in found} == {0} and len(found) == 6
    assert check(spark, [("a b", "en", "x")], 1, top=1) == []
    assert source_audit.audit(table(spark, [])).count() == 0


def test_many_sources(spark):
    rows = [(f"alpha beta gamma{'x' * (i % 5)} delta", "en", f"s{i % 60}") for i in range(240)]
    check(spark, rows, 10)
