"""Column expressions: parsing, keys, fee classes, ages, rates, transforms. All JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "fee not disclosed", and the four fee classes.
UNDISCLOSED_TEXTS = ("", "-", "?")
PAID, ZERO_FEE, UNDISCLOSED, MALFORMED = "paid", "zero_fee", "undisclosed", "malformed"

# Position groups, in tie-break order.
POSITIONS = ("GK", "DF", "MF", "FW")

# Lineup label -> position group.
LINEUP_GROUPS = {
    "Goalkeeper": "GK",
    "Centre-Back": "DF",
    "Left-Back": "DF",
    "Right-Back": "DF",
    "Sweeper": "DF",
    "Defender": "DF",
    "Defensive Midfield": "MF",
    "Central Midfield": "MF",
    "Attacking Midfield": "MF",
    "Left Midfield": "MF",
    "Right Midfield": "MF",
    "midfield": "MF",
    "Midfield": "MF",
    "Centre-Forward": "FW",
    "Second Striker": "FW",
    "Left Winger": "FW",
    "Right Winger": "FW",
    "Attack": "FW",
}

# Player profile label -> position group.
PROFILE_GROUPS = {"Goalkeeper": "GK", "Defender": "DF", "Midfield": "MF", "Attack": "FW"}

# Characters a plain decimal number may hold; keeps out inf, nan, hex and type suffixes like 1d.
_NUMBER_CHARACTERS = "0123456789.+-eE"

_WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(_c(c).cast("string"), F.lit(_WHITE))


def parse_date(c: Column | str) -> Column:
    """ISO text (with or without a time part, or as eight digits) to a date; anything else is null."""
    t = trimmed(c)
    compact = F.try_to_timestamp(F.when(t.rlike("^[0-9]{8}$"), t), F.lit("yyyyMMdd")).cast("date")
    return F.when(t.rlike("^[0-9]{8}$"), compact).otherwise(t.try_cast("timestamp_ntz").cast("date"))


def clean_id(c: Column | str) -> Column:
    """Trimmed text id; blank becomes null."""
    t = trimmed(c)
    return F.when(t != "", t)


def to_number(c: Column | str, trim: bool = True) -> Column:
    """Text to double, null when it is not a plain decimal number."""
    t = trimmed(c) if trim else _c(c)
    return F.when(F.translate(t, _NUMBER_CHARACTERS, "") == "", t.try_cast("double"))


def surrogate_key(entity: Column | str, on: Column | str, *parts: Column | str) -> Column:
    """First 16 hex characters of sha1 over the natural key joined by a pipe; null counts as ''."""
    day = F.date_format(_c(on), "yyyy-MM-dd")
    fields = [_c(entity).cast("string"), day, *(_c(p).cast("string") for p in parts)]
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(f, F.lit("")) for f in fields))), 1, 16)


def fee_class(raw: Column | str) -> Column:
    return class_of_fee(trimmed(raw), to_number(raw))


def class_of_fee(text: Column, num: Column) -> Column:
    """Fee class from the trimmed text and its number."""
    return (
        F.when(text.isNull() | text.isin(*UNDISCLOSED_TEXTS), UNDISCLOSED)
        .when(num.isNull() | (F.abs(num) == float("inf")) | (num < 0), MALFORMED)
        .when(num == 0, ZERO_FEE)
        .otherwise(PAID)
    )


def fee_value(raw: Column | str) -> Column:
    """The amount, only for a paid fee. Undisclosed never turns into 0."""
    return F.when(fee_class(raw) == PAID, to_number(raw))


def map_codes(c: Column | str, groups: dict[str, str]) -> Column:
    """Look a label up in a small fixed table; unmapped labels give null."""
    pairs = [F.lit(x) for kv in groups.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(c))


def both_present(a: Column | str, b: Column | str) -> Column:
    return _c(a).isNotNull() & _c(b).isNotNull()


def floor_age(born: Column | str, at: Column | str) -> Column:
    """Completed years by calendar fields, so someone born on 29 Feb turns on 1 Mar."""
    born, at = _c(born), _c(at)
    birthday_md = F.month(born) * 100 + F.dayofmonth(born)
    today_md = F.month(at) * 100 + F.dayofmonth(at)
    return (F.year(at) - F.year(born) - (today_md < birthday_md).cast("int")).cast("int")


def per_90(total: Column | str, minutes: Column | str, min_minutes: float) -> Column:
    total, minutes = _c(total), _c(minutes)
    return F.when((minutes >= min_minutes) & (minutes > 0), 90.0 * total / minutes)


def back_to_units(pred_log: Column | str) -> Column:
    """max(expm1(p), 0); a null or non-finite p, or an overflow, fails the job."""
    p = _c(pred_log)
    ok = is_finite(p) & (F.abs(F.expm1(p)) < float("inf"))
    return F.when(ok, F.greatest(F.expm1(p), F.lit(0.0))).otherwise(
        F.raise_error(F.lit("non-finite log prediction or overflow")).cast("double")
    )


def clamped(pred_log: Column | str) -> Column:
    return F.expm1(_c(pred_log)) < 0


def _plain_letters() -> tuple[dict[str, str], dict[str, str]]:
    """Letters whose compatibility form without marks is one other letter, or several."""
    one, many = {}, {"ß": "ss"}
    for code in [*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if bare and bare != c and not bare.isspace():
            (one if len(bare) == 1 else many)[c] = bare
    return one, many


def name_key(c: Column | str) -> Column:
    """Comparison key for names: compatibility forms, no combining marks, folded case, single spaces.

    Letters that do not decompose stay themselves (Ø is not O), and so do other quotation marks.
    """
    one, many = _plain_letters()
    t = F.lower(F.translate(_c(c), "".join(one), "".join(one.values())))
    for letter in ("ß", *(k for k in many if 0xFB00 <= ord(k) < 0xFB07)):
        t = F.replace(t, F.lit(letter), F.lit(many[letter]))
    t = F.translate(F.regexp_replace(t, r"\p{Mn}+", ""), "ς", "σ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def is_finite(c: Column | str) -> Column:
    c = _c(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def match_points(club: Column, home: Column, away: Column, hg: Column, ag: Column) -> Column:
    """3/1/0 from the club's side of the score, null if unplayed; wrong club fails the job."""
    played = hg.isNotNull() & ag.isNotNull()
    at_home = club.eqNullSafe(home)
    at_away = club.eqNullSafe(away)
    diff = F.when(at_home, hg - ag).otherwise(ag - hg)
    return (
        F.when(~played, F.lit(None).cast("double"))
        .when(
            ~at_home & ~at_away,
            F.raise_error(F.lit("appearance club is neither side of its game")).cast("double"),
        )
        .when(diff > 0, 3.0)
        .when(diff == 0, 1.0)
        .otherwise(0.0)
    )


def day_number(c: Column | str) -> Column:
    return F.unix_date(_c(c))


def hash_number(*parts: Column | str, digits: int = 15) -> Column:
    """Non-negative bigint from the first hex digits of md5 over the parts joined by a pipe."""
    text = F.concat_ws("|", *(_c(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")
