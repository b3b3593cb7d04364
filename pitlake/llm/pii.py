"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it is. Then transducers rewrite it: look-alike characters become
ASCII, invisible ones vanish, spelled digits become digits, and "at" and "dot" in an address become signs.
Each rewritten character remembers the source characters it came from, so an identifier that is found only
after rewriting is reported by its place in the source. Texts without any hint of a disguise skip this.

Every search goes forward once, so a text takes time in proportion to its length, whatever it holds.

What is read: an address with "at" or "dot" in brackets; with a spelled dot in its domain, unless the one word
before "at" is a word that speech puts there ("meet me at amazon dot com"); with a plain domain after "at", if
its local part has a letter and a digit, dot, underscore or plus; with spelled dots around a plain @. Numbers
with two spelled digits or more, or with one that ends the number or stands inside it. Ten to fifteen digits
spelled throughout are a phone number even without a plus. What stays out: "at" between one plain word and a
plain domain, tens and teens in words, words of other languages than the listed ones.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# From the first digit of a run only: a start inside a run matches or fails just as its first digit does.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    """Leftmost, non-overlapping: each @ with the address characters before it and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain identifiers, in order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(_small(p) for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Cyrillic and Greek letters that look like Latin ones, and what they look like.
_LOOKS = dict(zip(
    "АВСЕНІЈКМОРЅТХУаеіјорсухѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρι",
    "ABCEHIJKMOPSTXYaeijopcyxsdqwhABEZHIKMNOPTYXovpi", strict=True))
# Characters that show nothing.
_HIDDEN = "­​‌‍⁠﻿"
# Digits in words, from 0 to 9, in English, German, French and Spanish, and other names of 0.
_TENS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGITS = {w: str(i) for words in _TENS for i, w in enumerate(words.split())} | {"oh": "0", "zwo": "2"}


@cache
def _characters() -> tuple[dict[int, str | None], np.ndarray]:
    """Rewriting of single characters: look-alikes, compatibility forms and other scripts' digits."""
    table: dict[int, str | None] = {ord(k): v for k, v in _LOOKS.items()}
    for code in [*range(0x2000, 0x2400), *range(0xFE50, 0xFFF0), *range(0x1D400, 0x1D800), *range(0x660, 0x1A00)]:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and "!" <= plain <= "~" and plain != c:
            table[code] = plain
        elif (digit := unicodedata.decimal(c, None)) is not None:
            table[code] = str(digit)
    table |= {code: "-" for code in range(0x2010, 0x2016)} | {0x2212: "-", 0x2024: ".", 0x3002: ".", 0xA0: " ", 0x202F: " "}
    table |= {ord(c): None for c in _HIDDEN}
    mapped = np.zeros(0x110000, bool)
    mapped[list(table)] = True
    return table, mapped


_WORD = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_SPELT = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\s-]+(?={_WORD}\b|[0-9]))?(?:{_WORD}|[0-9]+)(?:[\s,-]{{1,2}}(?:{_WORD}(?![A-Za-z])|[0-9]+))+(?![A-Za-z])", re.I)
# Letters that stand in for digits inside a number of mostly digits.
_MIXED = re.compile(r"(?<![A-Za-z])\+?(?=[0-9OoIl]*[0-9])[0-9OoIl](?:[\x20().-]{0,2}[0-9OoIl]){6,}(?![A-Za-z])")
_MIXED_HINT = re.compile(r"[0-9][OoIl]|[OoIl][0-9]|[0-9][\x20.-][OoIl](?![A-Za-z])")
_AS_DIGIT = str.maketrans("OoIl", "0011")
_ENTITY = re.compile(r"&#(?:64|46|x40|x2e);|&(?:commat|period);", re.I)
_SPELT_ONE = re.compile(rf"plus|{_WORD}|[0-9]+", re.I)
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)"
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_ENDING = re.compile(r"[A-Za-z][A-Za-z-]+\Z")
_SIGN = re.compile(r"[\[({<]\s*(?:(?P<at>at|@)|dot|\.)\s*[\])}>]|(?<=\s)(?:(?P<word>at)|dot)(?=\s)|(?P<plain>@)", re.I)
# Words that stand before "at" in speech rather than name a mailbox.
_SPEECH = frozenset(
    "me us you him her it them this that here there is are was were be been am look looks looking arrive arrived arrives meet met see seen "
    "find found buy bought available and or not now only out up down in on live lives stay stayed sold shop order visit".split())
_SIGN_OR_DIGIT = re.compile(rf"(?P<dot>{_DOT})|(?P<digit>{_WORD})", re.I)
_PART = rf"(?:[0-9]{{1,3}}|{_WORD})"
_NUMBERS = re.compile(rf"(?<![A-Za-z0-9.]){_PART}(?:(?:{_DOT}|\.){_PART}){{3}}(?![A-Za-z0-9])", re.I)
_LOOSE = re.compile(r"@\s|(?<=\s)@")
_WRAPPED = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]")
_PLAIN_AT = re.compile(r"\sat\s+[a-z0-9-]+\.[a-z0-9]")
_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: What a text must hold to be rewritten, look-alike characters aside; linear automata over whole columns.
_HINTS = (
    rf"(?:{_WORD}|plus){_SPACE.replace(']', ',-]')}{{1,2}}(?:{_WORD}|[0-9])|[0-9]{_SPACE.replace(']', ',-]')}{{1,2}}{_WORD}"
    rf"|{_WORD}\.(?:{_WORD}|[0-9])|[0-9]\.{_WORD}",
    rf"{_SPACE}dot{_SPACE}|@{_SPACE}|{_SPACE}@|[\[({{<]{_SPACE}*(?:at|dot|@|\.){_SPACE}*[\])}}>]|{_SPACE}at{_SPACE}+[a-z0-9-]+\.",
    r"&#(?:64|46|x40|x2e);|&(?:commat|period);|[0-9][OoIl]|[OoIl][0-9]|[0-9][ .-][OoIl](?:[^A-Za-z]|$)",
)


def _stands(text: str, word: str) -> bool:
    """Whether the word stands in the lower-case text by itself."""
    at, n = text.find(word), len(word)
    while at >= 0:
        if not (text[at - 1 : at].isalnum() or text[at + n : at + n + 1].isalnum()):
            return True
        at = text.find(word, at + n)
    return False


class Rewritten:
    """A text with, for each character, where its source begins and ends."""

    def __init__(self, text: str):
        self.text = text
        self.first = np.arange(len(text))
        self.last = self.first + 1

    def characters(self) -> None:
        table, mapped = _characters()
        if self.text.isascii():
            return
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not mapped[codes].any():
            return
        kept = np.flatnonzero(~np.isin(codes, [c for c, v in table.items() if v is None]))
        self.text = self.text.translate(table)
        self.first, self.last = self.first[kept], self.last[kept]

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Ordered, separate (start, end, new text): each new character stands for the whole old range."""
        if not edits:
            return
        old = np.array([(a, b) for a, b, _ in edits])
        size = np.array([len(new) for _, _, new in edits])
        kept = np.diff(np.stack([np.append(0, old[:, 1]), np.append(old[:, 0], len(self.text))]), axis=0)[0]
        width = np.zeros(2 * len(edits) + 1, np.int64)
        width[::2], width[1::2] = kept, size
        begin = np.zeros(len(width), np.int64)
        begin[::2], begin[1::2] = np.append(0, old[:, 1]), old[:, 0]
        end = begin.copy()
        end[1::2] = old[:, 1] - 1
        inside = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        inside *= np.repeat(np.arange(len(width)) % 2 == 0, width)
        text, at = [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.first, self.last = self.first[np.repeat(begin, width) + inside], self.last[np.repeat(end, width) + inside]

    def digits(self) -> None:
        """Runs of digits, one or more of them in words, become digits without what stands between."""
        edits = []
        for m in _SPELT.finditer(self.text):
            parts = list(_SPELT_ONE.finditer(self.text, m.start(), m.end()))
            words = [p.group().lower() for p in parts]
            spelt = sum(w in _DIGITS for w in words)
            if not spelt or (spelt == 1 and not self._one_digit(m, words)):
                continue
            whole = spelt == len(words) and 10 <= spelt <= 15 and self.text[max(0, m.start() - 1) : m.start()] != "+"
            at = m.start()
            for p, word in zip(parts, words, strict=True):
                edits.append((at, p.end(), "+" * (whole and at == m.start()) + ("+" if word == "plus" else _DIGITS.get(word, word))))
                at = p.end()
        self.replace(edits)

    def _one_digit(self, m: re.Match, words: list[str]) -> bool:
        """Whether the only spelled digit of a run belongs to the number: inside it, or last before no further word."""
        if "," in m.group() or words[0] in _DIGITS:
            return False
        return words[-1] not in _DIGITS or not re.match(r"\s{1,2}\w", self.text[m.end() : m.end() + 3])

    def letters(self) -> None:
        """O and l inside numbers become 0 and 1, where digits outnumber them."""
        text = list(self.text)
        for m in _MIXED.finditer(self.text):
            odd = [i for i in range(m.start(), m.end()) if text[i] in "OoIl"]
            if 3 * len(odd) < sum(c.isalnum() for c in m.group()):
                for i in odd:
                    text[i] = text[i].translate(_AS_DIGIT)
        self.text = "".join(text)

    def entities(self) -> None:
        self.replace([(m.start(), m.end(), "@" if m.group().lower() in ("&#64;", "&#x40;", "&commat;") else ".") for m in _ENTITY.finditer(self.text)])

    def numbers(self) -> None:
        """Spelled dots and single spelled digits inside what has the shape of an ip."""
        self.replace([(s.start(), s.end(), "." if s.group("dot") else _DIGITS[s.group("digit").lower()])
                      for m in _NUMBERS.finditer(self.text) for s in _SIGN_OR_DIGIT.finditer(self.text, m.start(), m.end())])

    def addresses(self) -> None:
        """Signs of an address become @ and dots: from each at, backwards over names and forwards over labels."""
        text, ats, before, after = self.text, [], {}, {}
        for m in _SIGN.finditer(text):
            a, b, plain = m.start(), m.end(), bool(m.group("plain"))
            while a and text[a - 1].isspace():
                a -= 1
            while b < len(text) and text[b].isspace():
                b += 1
            if plain or m.group("at") or m.group("word"):
                ats.append((a, b, "word" if m.group("word") else "loose" if plain and b - a > 1 else "plain" if plain else "wrapped"))
            else:
                before[b], after[a] = a, b
        edits, done = [], 0
        for a, b, kind in ats:
            left, start = [], a
            while start > done:
                at = start
                while at > done and text[at - 1] in _NAME_CHARS:
                    at -= 1
                if at == start or (left and text[at:start].lower() == "at"):
                    start = left.pop()[1] if left and left[-1] else start
                    break
                start = at
                if start in before and before[start] > done:
                    left.append((before[start], start))
                    start = before[start]
                elif start - 1 > done and text[start - 1] == "." and text[start - 2] in _NAME_CHARS:
                    start -= 1
                else:
                    break
            local = text[start:a]
            right, labels, end = [], 0, b
            while m := _LABEL.match(text, end):
                if labels and right and right[-1][1] == end and m.group().lower() == "at":
                    end = right.pop()[0]
                    break
                end, labels, last = m.end(), labels + 1, m.group()
                if end in after:
                    right.append((end, after[end]))
                    end = after[end]
                elif end + 1 < len(text) and text[end] == "." and text[end + 1] in _NAME_CHARS:
                    end += 1
            if right and right[-1][1] == end:
                end = right.pop()[0]
            if start == a or labels < 2 or not self._address(kind, local, bool(left), bool(right), last):
                continue
            edits += [(p, q, ".") for p, q in reversed(left)]
            if kind != "plain":
                edits.append((a, b, "@"))
            edits += [(p, q, ".") for p, q in right]
            done = end
        self.replace(edits)

    @staticmethod
    def _address(kind: str, local: str, spelled_left: bool, spelled_right: bool, last: str) -> bool:
        if kind == "wrapped":
            return True
        if not _ENDING.match(last):
            return False
        if kind == "loose":
            return True
        if kind == "plain":
            return spelled_left or spelled_right
        marked = spelled_left or (any(c.isalpha() for c in local) and any(c in "._+" or c.isdigit() for c in local))
        return marked or (spelled_right and local.lower() not in _SPEECH)


def _kept(found: list, base: list) -> list:
    """Of (start, end): those that touch none of base, or hold all whole that they touch. Base is ordered and apart."""
    ends, out = [b for _, b in base], []
    for x, y in found:
        k = bisect_right(ends, x)
        whole = True
        while whole and k < len(base) and base[k][0] < y:
            whole = x <= base[k][0] and base[k][1] <= y and base[k] != (x, y)
            k += 1
        if whole:
            out.append((x, y))
    return out


def disguised_spans(text: str, base: list[tuple[int, int, int]], hinted: bool = True) -> list[tuple[int, int, int]]:
    """Identifiers that only the rewritten text shows, by their place in the source."""
    r = Rewritten(text)
    r.characters()
    if not hinted and r.text == text:
        return []
    if "&" in r.text:
        r.entities()
    if _MIXED_HINT.search(r.text):
        r.letters()
    low = r.text.lower()
    spelt, dot = any(_stands(low, d) for d in _DIGITS), _stands(low, "dot")
    if spelt:
        r.digits()
    if dot or ("@" in low and _LOOSE.search(low)) or (any(b in low for b in "[({<") and _WRAPPED.search(low)) or _PLAIN_AT.search(low):
        r.addresses()
    if spelt or dot:
        r.numbers()
    if r.text == text:
        return []
    found: list[list] = [[] for _ in KINDS]
    for a, kind, b in base_spans(r.text):
        x, y = int(r.first[a]), int(r.last[b - 1])
        if r.text[a:b] != text[x:y]:
            found[kind].append((x, y))
    return [(x, k, y) for k, own in enumerate(found) for x, y in _kept(own, [(a, b) for a, kind, b in base if kind == k])]


def find(text: str | None, hinted: bool = True) -> tuple[list, list]:
    """Plain identifiers, and all of them with the disguised ones, in order."""
    text = text or ""
    base = base_spans(text)
    return base, sorted({*base, *disguised_spans(text, base, hinted)})


def hints(column: pa.Array) -> list[bool]:
    """Whether each text may hold a disguise, apart from characters that look like others."""
    some = [pc.match_substring_regex(column, h, ignore_case=True) for h in _HINTS]
    return pc.fill_null(pc.or_(pc.or_(some[0], some[1]), some[2]), False).to_pylist()


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_email, n_ip, n_card, n_phone, base, spans, n_disguised.

    The counts and base are of identifiers that stand in the text as it is; spans has the disguised ones
    too, all as kind:start:end in code points, end exclusive, by start and then kind. Null and empty texts
    have none; null keys and repeated rows are read like any other; extra columns are ignored.
    """
    def run(batches):
        for batch in batches:
            found = [find(t, h) for t, h in zip(batch.column(1).to_pylist(), hints(batch.column(1)), strict=True)]
            cols = [pa.array([sum(k == n for _, k, _ in b) for b, _ in found], pa.int64()) for n in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *cols, pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(s) for _, s in found], pa.string()),
                 pa.array([len(s) - len(b) for b, s in found], pa.int64())],
                names=[key, *(f"n_{k}" for k in KINDS), "base", "spans", "n_disguised"])

    kind = docs.schema[key].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(
        run, f"`{key}` {kind}, {counts}, base string, spans string, n_disguised long")
