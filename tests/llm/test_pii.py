import random
import re
import time

import pyarrow as pa
import pytest

from pitlake.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(s[::-1])) % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-9:]) <= 255 and len(p.lstrip("0")) < 9 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_plain_ones_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "x-y", ".", "d@e.f", "1", "255", "256", "4111 1111 1111 1111", "+1 (415) 555-0134", "+", " ", "-", "0", "9" * 30, "é", "٣", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text,kind,source", [
    ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("write j.doe [at] example [dot] org!", "email", "j.doe [at] example [dot] org"),
    ("ann(at)example.com", "email", "ann(at)example.com"),
    ("an jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("j​o@exam​ple.com", "email", "j​o@exam​ple.com"),
    ("bob @ example.com", "email", "bob @ example.com"),
    ("＋1 (415) 555-0134", "phone", "＋1 (415) 555-0134"),
    ("call plus one four one five five five five one two three four ok", "phone", "plus one four one five five five five one two three four"),
    ("host 192 dot 168 dot 1 dot 10 up", "ip", "192 dot 168 dot 1 dot 10"),
    ("card four one one one 1111 1111 one one one one.", "card", "four one one one 1111 1111 one one one one"),
    ("ruf plus vier neun drei null eins zwei drei vier fünf sechs sieben an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs sieben"),
    ("card 4l11 1111 1111 llll", "card", "4l11 1111 1111 llll"),
    ("host 1O.20.30.40!", "ip", "1O.20.30.40"),
    ("bob&#64;example&#46;com", "email", "bob&#64;example&#46;com"),
    ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
    ("ask jane.doe42 at example.com today", "email", "jane.doe42 at example.com"),
    ("ask jane dot doe at example.com today", "email", "jane dot doe at example.com"),
    ("from jane dot doe@example.com, yes", "email", "jane dot doe@example.com"),
    ("from alice@mail.example dot com, yes", "email", "alice@mail.example dot com"),
    ("fon +1 415 555 013 four.", "phone", "+1 415 555 013 four"),
    ("call four one five five five five zero one three four", "phone", "four one five five five five zero one three four"),
    ("host one.two.3.four", "ip", "one.two.3.four"),
])
def test_disguises_map_back(text, kind, source):
    base, every = pii.find("ä " + text)
    assert base == [] or kind in ("email", "phone")
    new = [s for s in every if s not in base]
    assert [(pii.KINDS[k], ("ä " + text)[a:b]) for a, k, b in new] == [(kind, source)]


@pytest.mark.parametrize("text", [
    "meet me at amazon dot com", "we met at example.com", "it grew at 3 dot 5 percent", "version 2.0 at example.com", "one of 415 555 0134", "meet at example.com at noon", "see the dot at the end dot", "one two three", "a (at) b", "von Übergröße", "1.2.3 dot", "Il 1 O 2 lo 3", "tres o cuatro, un dos"])
def test_clean_texts(text):
    assert pii.find(text) == ([], [])


def test_a_word_after_a_plain_number_is_no_digit():
    base, every = pii.find("+1 415 555 0134 one of us, +1 415 555 0135, one")
    assert base == every and len(base) == 2


@pytest.mark.parametrize("unit", ["7", "4 ", "seven ", "one,", "a dot ", "a at ", "a@", "a @ ", "b. ", "1.", "1O", "+1 ", "[at] ", "( ", " ", "a.", "x dot y at ", "1 dot ", "&#64;", "(dot)"])
def test_a_megabyte_takes_time_in_proportion(unit):
    text = unit * (1_000_000 // len(unit))
    start = time.perf_counter()
    pii.find(text)
    pii.find(text + "a")
    assert time.perf_counter() - start < 12


def test_long_runs_of_digits_end_as_the_patterns_say():
    for text in ("9" * 3000, "9" * 3000 + ".1.2.3", "1.2.3.4.5.6.7.8.9", "1.2.3.4" + "5" * 2000, "0" * 500 + "1.2.3.4"):
        assert pii.base_spans(text) == plain(text)


def test_columns_are_searched_for_hints_first():
    rng = random.Random(4)
    parts = ["jane", ".", " dot ", " at ", "@", "doe", "example", "com", " ", "four", " one", "1", "415", "+", "[at]", "(dot)", ",", "-", "O", "l", "&#64;", "\u2003", "а", "seven", "plus ", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(6000)]
    found = [pii.find(t, h) for t, h in zip(texts, pii.hints(pa.array(texts)), strict=True)]
    assert found == [pii.find(t) for t in texts]
    assert sum(len(e) > len(b) for b, e in found) > 50 and pii.hints(pa.array([None, ""], pa.string())) == [False, False]
    for text, (base, every) in zip(texts, found, strict=True):
        assert base == plain(text) and set(base) <= set(every)


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "a@b.c and d[at]e.fg"), (None, "+1 415 555 0134"), (3, "a@b.c and d[at]e.fg"), (4, "w " * 200_000 + "a@b.c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int").repartition(2)
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base, r.spans, r.n_disguised) for r in pii.personal_data(df).collect()}
    assert got == {
        (1, 0, 0, 0, 0, "", "", 0), (2, 0, 0, 0, 0, "", "", 0), (3, 1, 0, 0, 0, "email:0:5", "email:0:5,email:10:19", 1),
        (None, 0, 0, 0, 1, "phone:0:15", "phone:0:15", 0), (4, 1, 0, 0, 0, "email:400000:400005", "email:400000:400005", 0)}
    assert pii.personal_data(df).count() == 6 and pii.personal_data(df.limit(0)).count() == 0
