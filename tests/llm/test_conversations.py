import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from pitlake.llm import conversations as cv

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(t, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        s = text.strip(WHITE)
        out.append("blank" if not s else "duplicate" if (role, text) in seen else "" if s[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit) from the back, with the repaired rows."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, inserted):
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, "", ()))

        def go(price, edit, to, at, row, ins=0):
            if to is not None:
                c, e, r = best(at, to, ins)
                if c is not None:
                    out.append((c + price, edit + e, row + r))

        for w, name in (("u", "user"), ("a", "assistant")):
            if inserted < 2:
                go(5, "I", after.get((state, w)), i, (f"{name}:",), inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            go(2, "D", state, i + 1, ())
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] == "truncated" else 0
                go(more, "K", after.get((state, role[:1])), i + 1, (f"{role}:{text}",))
                for w, name in (("u", "user"), ("a", "assistant")):
                    go(1 + more, "R", after.get((state, w)), i + 1, (f"{name}:{text}",))
        return min(out, key=lambda r: r[:2]) if out else (None, "", ())

    return best(0, "", 0)


def brute(rows):
    out = []
    for c in {r[0] for r in rows}:
        own = damage([r for r in rows if r[0] == c])
        found = faults(own)
        cost, audit, said = cheapest(own, found)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((c, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(rng, n, first=0):
    rows = []
    for c in range(first, first + n):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "Ursula", "", None])
            rows.append((c, rng.choice([t, t, t, 2 * t, None]), role, rng.choice(["Yes.", "No! ", "what", "é?\n", "", " \t", None, "a b", f"{c} {t}."])))
    return rows


SHAPE = "conv_id long, turn long, role string, text string, seen int, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SHAPE)


def test_equals_search_from_the_back(spark):
    rng = random.Random(7)
    rows = rows_of(rng, 500)
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho.")]
    rows += [(900, t, "user", "Again.") for t in range(60)]  # one text over and over
    rows += [(901, 3, "user", "Same.")] * 30
    rows += [(902, t, ("user", "assistant")[t % 2], "x" * 50_000 + f" {t}.") for t in range(40)]
    rows += [(903, 2**40 * t, "user", f"{t}.") for t in range(5)]
    got = sorted(map(tuple, cv.report(frame(spark, rows).repartition(5), damage=True).collect()), key=str)
    assert got == brute(rows)
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = cv.report(frame(spark, [(gone, 0, "user", "Hi.")]), damage=True).collect()
    assert [tuple(r) for r in empty] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.report(frame(spark, rows).limit(0)).collect() == []


def test_edits_give_the_repaired_conversation(spark):
    rng = random.Random(8)
    df = frame(spark, rows_of(rng, 150)).repartition(3)
    edits = {}
    for r in cv.repair(df, damage=True).collect():
        edits.setdefault(r.conv_id, []).append(r)
    for r in cv.report(df, damage=True).collect():
        own = sorted(edits.get(r.conv_id, []), key=lambda e: e.place)
        assert "".join(e.edit for e in own) == r.audit
        kept = [e for e in own if e.edit != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(e.role[:1] for e in kept))
        assert hashlib.sha256("\n".join(f"{e.role}:{e.text}" for e in kept).encode()).hexdigest() == r.repaired_sha256
    assert cv.repair(df.limit(0)).collect() == []


def settle(rows):
    c, cost, audit = cv.Conversation(0), 0, ""
    for t, (role, text) in enumerate(rows):
        for e, *_ in c.add(t, role.encode(), text.encode(), False):
            audit += e
    cost, rest = c.repair.finish()
    early = len(audit)
    return cost, audit + "".join(e for e, *_ in rest), early, c.repair.most


def test_settled_edits_leave_memory():
    rng = random.Random(9)
    rows = [("system", "Be brief.")]
    for i in range(3000):
        rows.append((("user", "assistant")[i % 2] if rng.random() > 0.1 else "user", f"{i}" + ("." if rng.random() > 0.1 else "")))
    cost, audit, early, most = settle(rows)
    want = [(t, r, x) for t, (r, x) in enumerate(rows)]
    part = want[:81]
    assert settle(rows[:81])[:2] == cheapest(part, faults(part))[:2]
    assert early > len(audit) - 100 and most < 200 and cost > 0


@pytest.mark.parametrize("seed", range(4))
def test_every_short_conversation(seed):
    roles = ["user", "assistant", "system", "tool"]
    rng = random.Random(seed)
    for _ in range(800):
        rows = [(t, rng.choice(roles), rng.choice([f"{t}.", f"{t}", " "])) for t in range(rng.randrange(7))]
        assert settle([r[1:] for r in rows])[:2] == cheapest(rows, faults(rows))[:2]
