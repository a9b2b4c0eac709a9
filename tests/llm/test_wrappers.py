"""Wrappers: what a host's other pages change, broken markup, and expressions that cover all pages they come from."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from proofgrid.llm import html_wrapper as hw


def wrapper_of(pages):
    whole = None
    for page in pages:
        e = hw.fold(hw.read_page(page))
        whole = e if whole is None else hw.align(whole, e)
    return hw.Wrapper(whole)


def texts(page, others=()):
    return wrapper_of([page, *others]).texts(hw.read_page(page))


def test_other_pages_of_the_host_decide():
    notice, story = "All about our offers and how to reach us every day of the week", "A short story."
    page = f"<body><div class=x><p>{notice}</div><div class=y><p>{story}</div>"
    alike = [f"<body><div class=x><p>{notice}</div><div class=y><p>Story {k}, told anew</div>" for k in range(4)]
    unlike = [f"<body><div class=x><p>Column {k} about other offers and another way to reach us</div><div class=y><p>{story}</div>" for k in range(4)]
    assert texts(page, alike) == [story] and texts(page, unlike) == [notice]


def test_a_notice_among_paragraphs_goes():
    page = lambda k: f"<article><p>Story {k} begins with a sentence of its own {k}<p>It goes on {k} for a while {k}<p>Join our list!<p>and ends {k} here</article>"
    assert texts(page(0), map(page, range(1, 5))) == ["Story 0 begins with a sentence of its own 0", "It goes on 0 for a while 0", "and ends 0 here"]
    copy = "<article><p>One<p>Two sentences<p>Three of them<p>end {}</article>"  # near copies keep what they share
    assert texts(copy.format(0), [copy.format(k) for k in range(1, 5)]) == ["One", "Two sentences", "Three of them", "end 0"]


@pytest.mark.parametrize("page, want", [
    ("<article><div class='social science'>One two</div><div class='ad-hoc'>three</div><div class='social share-bar'>go</div></article>", ["One two", "three"]),
    ("<article><p title=it's>One two three</p><p data-id=comments id='a\"b'>four</article>", ["One two three", "four"]),
    ("<article>" + "<div>" * 250 + "deep" + "</div>" * 250 + "<p>tail</p></article><p>out", ["deep", "tail"]),
    ("<article><p>a &lt;b&gt; &amp; c\n\t d<!-- <p>no --><script>'<p>'</script></article>", ["a <b> & c d"]),
    ("<article><p " + "a=\"" * 2000 + "></article>", []),
    ("<", []), ("", []), (None, []),
])
def test_markup(page, want):
    assert [t for t in texts(page) if t != "<"] == want


def accepts(items, kids):
    """Whether a list of expression items spells the labels of kids, by trying everything."""
    if not items:
        return not kids
    head, rest = items[0], items[1:]
    if head[2] and accepts(rest, kids):
        return True
    if head[0] == "()":
        return any(once(head, kids[:k]) and (accepts(rest, kids[k:]) or head[1] and accepts([[*head[:2], 0, *head[3:]], *rest], kids[k:])) for k in range(1, len(kids) + 1))
    if kids and kids[0][0] == head[0] and (head[0] == hw.TEXT or accepts(head[3], kids[0][1])):
        return accepts(rest, kids[1:]) or bool(head[1]) and accepts([[*head[:2], 0, *head[3:]], *rest], kids[1:])
    return False


def once(group, kids):
    return accepts(group[3], kids)


def some_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["p", "div", "section"])
        out += f"<{tag}>{some_page(rng, depth + 1) if tag != 'p' and depth < 2 else 'text %d' % rng.randint(0, 99)}</{tag}>"
    return out


def test_expressions_cover_their_pages():
    for seed in range(1000):
        rng = random.Random(seed)
        pages = [hw.read_page(some_page(rng)) for _ in range(3)]
        one = hw.fold(pages[0])
        assert accepts(one[3], pages[0][1])
        both = one
        for p in pages[1:]:
            both = hw.align(both, hw.fold(p))
        assert both[4][0] == 3 and all(accepts(both[3], p[1]) for p in pages), seed


def test_order_and_partitions_do_not_matter(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<body><nav>n{i}</nav><div><p>Join our list!</div><article><p>text number {i}<p>more {i % 7}</article>" * (1 + i % 3), "clash", 1) for i in range(60)]
    rows += [rows[0], (60, None, None, "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    a, b = (sorted(map(tuple, hw.extract(x).collect()), key=str) for x in (df.repartition(5), df.orderBy(F.desc("page_id")).coalesce(1)))
    assert a == b and len(a) == len(rows)


def words(page, n, salt):
    rng = random.Random(f"{page} {salt}")
    return " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n // 8)).strip()


@pytest.mark.parametrize("page, kept", [
    # a block with most of the text isn't all of it
    (lambda k: f"<body><nav><a>Home</a></nav><div><p>{words(k, 100, 1)}</p><section>{words(k, 320, 2)}</section><section>{words(k, 100, 3)}</section></div><footer>{words(0, 60, 4)}</footer>", (1, 2, 3)),
    # an article beside a longer story is a part of it
    (lambda k: f"<body><nav><a>Home</a></nav><div><p>{words(k, 500, 1)}</p><p>{words(k, 500, 2)}</p><article>{words(k, 260, 3)}</article></div>", (1, 2, 3)),
    # a short paragraph before the block that holds nearly all
    (lambda k: f"<body><div><p>{words(k, 40, 1)}</p><div><p>{words(k, 900, 2)}</p><p>{words(k, 900, 3)}</p></div></div>", (1, 2, 3)),
    # text outside main, and articles within it that hold the smaller part
    (lambda k: f"<body><p>{words(k, 90, 4)}</p><main><p>{words(k, 900, 1)}</p><article><p>{words(k, 400, 2)}</p></article></main>", (1, 2)),
    # an article with all but some unnamed lines
    (lambda k: f"<body><div>{words(k, 40, 4)}</div><article><p>{words(k, 500, 1)}</p><div><p>{words(k, 400, 2)}</p></div></article>", (1, 2)),
])
def test_regions_lose_no_main_text(page, kept):
    wrapper = wrapper_of(page(k) for k in range(6))
    for k in range(6):
        got = wrapper.texts(hw.read_page(page(k)))
        assert [next(s for s in range(5) if t.startswith(words(k, 32, s))) for t in got] == list(kept)
        assert all(f">{t}<" in page(k) for t in got)


def test_pages_of_many_unlike_blocks():
    def page(k, n):
        rng = random.Random(k)
        names = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
        return "<body>" + "".join(f"<div class={c}><p>{c} {k}</p></div>" for c in names)

    start = time.process_time()
    pages = [hw.read_page(page(k, 40_000)) for k in range(2)]
    one, two = map(hw.fold, pages)
    tracemalloc.start()
    whole = hw.align(one, two)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hw.Wrapper(whole).texts(pages[0])) == 40_000 and peak < 200e6 and time.process_time() - start < 60


def test_partners_rise_and_are_equal():
    for seed in range(300):
        rng = random.Random(seed)
        x, y = ([(rng.choice("abc"),) for _ in range(rng.randint(0, 9))] for _ in range(2))
        pairs = hw._partners(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert pairs or not set(x) & set(y)
    x = [(c,) for c in "abcdefg"]
    assert [x[i][0] for i, _ in hw._partners(x, [(c,) for c in "axcdzfg"])] == list("acdfg")
