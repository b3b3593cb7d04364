import itertools
import random
import time

import numpy as np
import pytest

from pitlake.llm import html_text as H


@pytest.fixture(scope="module")
def chain():
    return H.fit(H.labelled_pages([]))


def test_held_out_layouts(chain):
    pages = H.labelled_pages([], count=150, seed=77)
    wrong = sum(a != b for f, y in pages for a, b in zip(chain.viterbi(f), y, strict=True))
    assert wrong <= 0.03 * sum(len(y) for _, y in pages)


def test_viterbi_equals_all_label_sequences(chain):
    rng = random.Random(1)
    for _ in range(30):
        weights = {f: rng.gauss(0, 2) for f in "abcde"}
        c = H.Chain(weights, rng.gauss(0, 1), np.array([[rng.gauss(0, 1) for _ in "xy"] for _ in "xy"]), np.array([rng.gauss(0, 1), rng.gauss(0, 1)]))
        own = [rng.sample("abcde", 2) for _ in range(6)]

        def value(y, c=c, own=own):
            v = c.first[y[0]] + sum(c.bias + sum(c.weights[f] for f in own[i]) for i in range(6) if y[i])
            return v + sum(c.pair[y[i], y[i + 1]] for i in range(5))

        assert abs(value(c.viterbi(own)) - max(value(y) for y in itertools.product((0, 1), repeat=6))) < 1e-9


@pytest.mark.parametrize("page,text", [
    ("<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One  two\nthree&nbsp;four.<p>Five <b>six</b>.</article><footer>&copy; x</footer>",
     "A & B One two three four. Five six ."),
    ("<article><p>Read this long piece of prose, it is fine.</p><script>var t='</p>';</script></article><div class='comments'><p>Nice one, I liked it a lot.</p></div>",
     "Read this long piece of prose, it is fine."),
    ("", ""), (None, ""), ("<html><script>x</script></html>", ""),
])
def test_pages(chain, page, text):
    assert chain.text(page) == text.replace("six .", "six.")


@pytest.mark.parametrize("page", ["<p", "<p class='x", "a < b > c", "</p></div>", "<!-- x", "<script>", "<a href=\"x'y>z</a>", "<td><tr><li><p>" * 50, "<" * 2000, "<![CDATA[x]]>", "&#xZZ; &amp &#0;"])
def test_broken_markup_is_read(chain, page):
    assert isinstance(chain.text(page), str)


@pytest.mark.parametrize("unit", [
    "<a ", '<p a="', "<p a='\"", "<math>", "<template>", "<svg><title>", "<![CDATA[", "<!-", "<b>x", "<b><hr>", "</x>", "<i></b>", "<div>x", "<p \">\" '", "<a href=x>y",
    "<p>x<b>y", "< ", "<li>x", "&", "<div class='c1 c2'>x</p>", "</script ", "<a class=", "<td><p><b>"])
def test_long_broken_markup_takes_time_in_proportion(chain, unit):
    page = unit * (300_000 // len(unit))
    for end in ("", ">", "'", "\">z"):
        start = time.perf_counter()
        chain.text(page + end)
        assert time.perf_counter() - start < 4


@pytest.mark.parametrize("page,text", [
    ("<article><p>The energy is <math><mi>E</mi><mo>=</mo><mn>4</mn></math> as known to all readers of this.</p></article>",
     "The energy is E=4 as known to all readers of this."),
    ("<article><p>Some prose stands here, before the <object>fallback of an object</object> and <noscript>plain words</noscript> end.</p></article>",
     "Some prose stands here, before the fallback of an object and plain words end."),
    ("<article><p>One sentence stands here, with \"quotes\" and 'more' of it.</p><p title='a > b' class=x>Another sentence <img alt=\"1 > 0\"> follows, of some words.</p></article>",
     "One sentence stands here, with \"quotes\" and 'more' of it. Another sentence follows, of some words."),
])
def test_only_listed_elements_are_left_out(chain, page, text):
    assert chain.text(page) == text


def test_features_of_open_elements():
    found = dict(H.blocks("<div class='main'><p>a<b>b</b><p>c</div><ul><li>d<li>e</ul>f"))
    assert list(found) == ["ab", "c", "d", "e", "f"]
    assert {"tag=div", "is=main", "tag=p"} <= set(found["c"]) and not {"tag=div", "tag=p"} & set(found["d"])
    assert found["d"].count("tag=li") == 1 and "tag=ul" in found["e"] and not any(f.startswith("tag=") for f in found["f"])
    assert "tag=div" not in dict(H.blocks("<div><p>a", {"tag=p"}))["a"]


def test_table(spark):
    body = "<article><p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>Some text stands here, and more.</p></article>"), (3, "w", body), (3, "w", body)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int").repartition(2)
    got = sorted(((r.page_id, r.url, r.n_chars, len(r.text)) for r in H.main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", 0, 0), (2, None, 0, 0), (None, "v", 32, 32), (3, "w", 999_999, 999_999), (3, "w", 999_999, 999_999)], key=str)
    assert H.main_text(df.limit(0)).collect() == []
