"""Calendar rules of six fields: minute, hour, day, month, weekday, year.

A field is ``*``, a list ``a,b``, a range ``a-b``, a step ``*/n`` or one value,
tested in that order. Steps keep the multiples of n, not offsets from the first
value. All six fields must hold, day of month and weekday together.

There are two readers of the same rules. :func:`compile_rule` reads one rule on
the driver and gives plain predicates; :func:`listed_values` and its neighbours read a
column of rules inside Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    name: str
    low: int
    high: int
    names: tuple[str, ...] = ()  # value of names[i] is i + 1

    def of(self, ts: Column) -> Column:
        """This field of a timestamp."""
        if self.name == "weekday":
            return F.weekday(ts) + 1  # Monday is 1
        return getattr(F, self.name)(ts)


# Field ranges and the names allowed in them.
FIELDS = (
    Field("minute", 0, 59),
    Field("hour", 0, 23),
    Field("day", 1, 31),
    Field("month", 1, 12, ("JAN", "FEB", "MAR", "APR", "MAY", "JUN",
                           "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")),
    Field("weekday", 1, 7, ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")),
    Field("year", 2014, 2031),
)

MINUTE, HOUR, DAY, MONTH, WEEKDAY, YEAR = FIELDS

_DIGITS = "^[0-9]+$"
_STEP = "^[*]/[+]?([0-9]+)$"
_ANY_BITS = -1


# -- one rule, on the driver ---------------------------------------------------


def compile_rule(pattern: str) -> dict[str, tuple[int, ...] | None]:
    """Allowed values per field, None for ``*``; ValueError for a bad rule."""
    words = pattern.upper().split()
    if len(words) != len(FIELDS):
        raise ValueError(f"{pattern!r} has {len(words)} fields, expected {len(FIELDS)}")
    return {f.name: _read_field(f, word) for f, word in zip(FIELDS, words)}


def _read_field(field: Field, word: str) -> tuple[int, ...] | None:
    def number(text: str) -> int:
        if re.match(_DIGITS, text):
            return int(text)
        if text in field.names:
            return field.names.index(text) + 1
        raise ValueError(f"{field.name}: cannot read {text!r}")

    if word == "*":
        return None
    if "," in word:
        values = {number(item) for item in word.split(",")}
    elif "-" in word:
        ends = word.split("-")
        kinds = {bool(re.match(_DIGITS, end)) for end in ends}
        if len(ends) != 2 or len(kinds) != 1:
            raise ValueError(f"{field.name}: cannot read range {word!r}")
        values = set(range(number(ends[0]), number(ends[1]) + 1))
    elif "/" in word:
        step = re.match(_STEP, word)
        if not step or int(step[1]) == 0:
            raise ValueError(f"{field.name}: cannot read step {word!r}")
        values = set(range(field.low, field.high + 1)) & set(
            range(0, field.high + 1, int(step[1]))
        )
    else:
        values = {number(word)}
    if not values or min(values) < field.low or max(values) > field.high:
        raise ValueError(f"{field.name}: {word!r} is outside {field.low}..{field.high}")
    return tuple(sorted(values))


def cron_match(ts: Column | str, pattern: str) -> Column:
    """True when the timestamp lies in a minute the rule names.

    A rule that names years also gives a plain range on ``ts``, which reaches the
    file scan as a pushed filter.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    rule = compile_rule(pattern)
    tests = [f.of(ts).isin(*rule[f.name]) for f in FIELDS if rule[f.name] is not None]
    if rule["year"]:
        first, last = rule["year"][0], rule["year"][-1]
        tests.insert(0, ts >= F.lit(f"{first}-01-01 00:00:00").cast("timestamp_ntz"))
        tests.insert(1, ts < F.lit(f"{last + 1}-01-01 00:00:00").cast("timestamp_ntz"))
    return reduce(lambda a, b: a & b, tests, ts.isNotNull())


# -- a column of rules, inside Spark -------------------------------------------
#
# Written as SQL text: the expressions are long, and text reaches Spark in one call.


def cron_words(cron: Column) -> Column:
    """Upper-case words of the rule text."""
    return F.regexp_extract_all(F.upper(cron), F.lit(r"\S+"), F.lit(0))


def cron_word(words: str, place: int) -> Column:
    """One word from the column of words; NULL unless there is one for every field."""
    return F.when(F.size(words) == len(FIELDS), F.get(words, F.lit(place)))


def _number(text: str, field: Field) -> str:
    names = ", ".join(f"'{name}'" for name in field.names)
    named = f"CAST(nullif(array_position(array({names}), {text}), 0) AS INT)" if names else "NULL"
    return f"CASE WHEN {text} RLIKE '{_DIGITS}' THEN try_cast({text} AS INT) ELSE {named} END"


def listed_values(word: str, field: Field) -> Column:
    """Values the word in column ``word`` lists, unchecked; NULL if it cannot be read."""
    ends = f"split({word}, '-')"
    low, high = f"get({ends}, 0)", f"get({ends}, 1)"
    # a step too long for an int still keeps 0
    step = f"coalesce(try_cast(regexp_extract({word}, '{_STEP}', 1) AS INT), {2**31 - 1})"
    return F.expr(
        f"""CASE
        WHEN contains({word}, ',') THEN transform(split({word}, ','), x -> {_number("x", field)})
        WHEN contains({word}, '-') THEN CASE
          WHEN size({ends}) = 2
           AND ({low} RLIKE '{_DIGITS}') = ({high} RLIKE '{_DIGITS}')
           AND {_number(low, field)} BETWEEN {field.low} AND {_number(high, field)}
           AND {_number(high, field)} <= {field.high}
          THEN sequence({_number(low, field)}, {_number(high, field)}) END
        WHEN contains({word}, '/') THEN CASE
          WHEN {word} RLIKE '{_STEP}' THEN get(transform(array({step}), n ->
            filter(sequence({field.low}, {field.high}), v -> try_mod(v, n) = 0)), 0) END
        ELSE array({_number(word, field)}) END"""
    )


def allowed_values(word: str, listed: str, field: Field) -> Column:
    """Listed values in order: NULL for ``*``, an empty array for a bad field."""
    good = f"forall({listed}, v -> coalesce(v BETWEEN {field.low} AND {field.high}, false))"
    return F.expr(
        f"""CASE WHEN {word} = '*' THEN CAST(NULL AS ARRAY<INT>)
        WHEN coalesce({good}, false) THEN array_sort(array_distinct({listed}))
        ELSE CAST(array() AS ARRAY<INT>) END"""
    )


def _first_bit(field: Field) -> int:
    return field.low if field is YEAR else 0


def value_mask(values: str, field: Field) -> Column:
    """Allowed values as bits of a bigint (bit 0 is value 0, for years 2014); ``*`` is -1."""
    bit = f"shiftleft(1L, v - {_first_bit(field)})"
    return F.expr(f"coalesce(aggregate({values}, 0L, (mask, v) -> mask | {bit}), {_ANY_BITS}L)")


def in_mask(mask: str, value: Column, field: Field) -> Column:
    """Is the value among the bits of the mask column?"""
    shifted = F.call_function("shiftright", F.col(mask), value - _first_bit(field))
    bit = shifted.bitwiseAND(F.lit(1).cast("bigint")) == 1
    if field is YEAR:  # bits name a fixed span of years, * any year
        return (F.col(mask) == _ANY_BITS) | (value.between(field.low, field.high) & bit)
    return bit
