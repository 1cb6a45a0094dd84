"""Forgiving readers for dirty text columns, and checks of single values.

Patterns end in ``\\n?\\z``: one trailing newline is allowed, other line ends are
not, whatever the regex engine takes ``$`` to mean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.bind import let

END = r"\n?\z"

# The accepted forms of each field.
MEMORY = r"(?i)^[0-9]+(k|kb|m|mb|g|gb|t|tb|p|pb)" + END
MASTER_URL = r"^spark://([\w.-]+):([0-9]+)" + END
UI_URL = r"^https?://([\w.-]+):([0-9]+)" + END
JDBC_URL = r"^jdbc:mysql://([\w.]+):([0-9]+)/(\w+)\?user=(\w+)&password=(\S+)" + END
ENTRYPOINT = r"^\w+(\.\w+)*" + END
JOB_STATUSES = ("READY", "DELAYED", "RUNNING", "FINISHED", "CLOSED")
TIMETABLE_STATUSES = ("ACTIVE", "PAUSED", "CANCELLED")

# Our own words for generated names; any list may be passed instead.
ADJECTIVES = ("amber", "brisk", "clear", "deep", "eager", "fair", "gentle", "high",
              "keen", "light", "mellow", "neat", "open", "plain", "quick", "round")
NOUNS = ("anchor", "barge", "canal", "delta", "estuary", "ferry", "gulf", "harbour",
         "inlet", "jetty", "lagoon", "marina", "oar", "pier", "reef", "sail")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def floor_div(value: Column, unit: int) -> Column:
    """Whole units in a bigint, rounded down, without a detour over doubles."""
    unit = F.lit(unit).cast("bigint")
    return F.call_function("div", value - F.pmod(value, unit), unit)


# -- values or defaults --------------------------------------------------------


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json(text: Column | str) -> Column:
    """Whether the whole text is one JSON value; FALSE for NULL.

    The parsers stop at a value's end and never see what follows. As the only item of a list, a value may be followed by
    nothing but white space and what closes the list; as a member of an object, by nothing that closes a list. So a text
    that fits both places has no tail. NaN and Infinity are no JSON; of equal keys any may come first.
    """
    text = _col(text)
    item = F.from_json(F.concat(F.lit("["), text, F.lit("\n]")), T.ArrayType(T.StringType()), _STRICT)
    member = F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("\n}")), "v string, bad string", {**_STRICT, "columnNameOfCorruptRecord": "bad"})
    return F.coalesce((F.size(item) == 1) & member.isNotNull() & member["bad"].isNull(), F.lit(False))


def json_or_else(text: Column | str, schema: T.DataType, default: Column | None = None) -> Column:
    """Parsed JSON, or the default where the text is NULL, is not JSON as a whole or does not fit the schema."""
    text = _col(text)
    default = F.lit(None) if default is None else default
    if not isinstance(schema, T.StructType):
        return F.coalesce(F.when(is_json(text), F.from_json(text, schema, _STRICT)), default.cast(schema))
    bad = "_unreadable"
    widened = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json(text, widened, {**_STRICT, "columnNameOfCorruptRecord": bad})
    readable = is_json(text) & parsed.isNotNull() & parsed[bad].isNull()
    return F.when(readable, parsed.dropFields(bad)).otherwise(default.cast(schema))


def int_or_else(text: Column | str, default: int | None) -> Column:
    """A whole number with optional sign and outer blanks, else the default."""
    text = _col(text)
    number = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*\z"), F.trim(text).try_cast("bigint"))
    return F.coalesce(number, F.lit(default).cast("bigint"))


def bool_or_else(text: Column | str, default: bool | None) -> Column:
    """true/1/yes and any other text are TRUE, false/0/no and '' FALSE, NULL the default."""
    text = F.lower(_col(text))
    return F.when(text.isNull(), F.lit(default).cast("boolean")).otherwise(
        ~text.isin("false", "0", "no", "")
    )


# -- command line text ---------------------------------------------------------

_BLANK = r"[ \t\r\n]"
_PIECE = r"""[^ \t\r\n"'\\]++|\\[\s\S]|"(?:[^"\\]|\\[\s\S])*+"|'[^']*+'"""
_TOKEN = f"(?:{_PIECE})++"


def parse_args(text: Column | str) -> Column:
    """Shell words as an array; NULL where a quote or escape is left open."""
    text = _col(text)

    def unquote(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        return (
            F.when(piece.startswith("'"), inner)
            .when(piece.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(piece.startswith("\\"), F.substring(piece, F.lit(2), F.lit(1)))
            .otherwise(piece)
        )

    def word(token: Column) -> Column:
        pieces = F.regexp_extract_all(token, F.lit(_PIECE), F.lit(0))
        return F.array_join(F.transform(pieces, unquote), "")

    words = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), word)
    rest = F.regexp_replace(text, _TOKEN, "")
    return F.when(rest.rlike(rf"^{_BLANK}*\z"), words)


def parse_options(text: Column | str) -> Column:
    """Shell words holding ``=`` as a map, split at the first ``=``; the last key wins.

    NULL where the text does not split into shell words.
    """
    pairs = F.transform(
        F.filter(parse_args(text), lambda w: w.contains("=")),
        lambda w: F.struct(
            F.substring_index(w, "=", 1).alias("k"),
            F.substring(w, F.instr(w, "=") + 1, F.length(w)).alias("v"),
        ),
    )

    def last_of_each(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        last = F.transform(
            keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
        )
        return F.map_from_arrays(keys, last)

    return let(pairs, last_of_each)


def merge_options(base: Column | str, overrides: Column | str) -> Column:
    """Both maps together; the right side wins."""

    def merged(right: Column) -> Column:
        kept = F.map_filter(_col(base), lambda k, _: ~F.map_contains_key(right, k))
        return F.map_concat(kept, right)

    return let(_col(overrides), merged)


def job_options(text: Column | str, driver_memory: Column, executor_memory: Column) -> Column:
    """Options text as a map in which the two memory fields override the text."""
    memory = F.create_map(
        F.lit("spark.driver.memory"), F.lower(driver_memory),
        F.lit("spark.executor.memory"), F.lower(executor_memory),
    )
    return merge_options(parse_options(text), memory)


# -- checks and parts ----------------------------------------------------------


def is_memory(value: Column | str) -> Column:
    return _col(value).rlike(MEMORY)


def is_priority(value: Column | str) -> Column:
    return int_or_else(_col(value).cast("string"), -1) >= 0


def is_master_url(value: Column | str) -> Column:
    return _col(value).rlike(MASTER_URL)


def is_ui_url(value: Column | str) -> Column:
    return _col(value).rlike(UI_URL)


def is_entrypoint(value: Column | str) -> Column:
    return _col(value).rlike(ENTRYPOINT)


def is_jar_path(value: Column | str) -> Column:
    value = _col(value)
    return value.startswith("/") & F.lower(value).endswith(".jar")


def is_jdbc_url(value: Column | str) -> Column:
    return _col(value).rlike(JDBC_URL)


def is_time(value: Column | str) -> Column:
    return _col(value) > 0


def parse_uri(value: Column | str) -> Column:
    """Struct (host, port, database, user) of a master, UI or JDBC address; NULL if none fits."""
    value = _col(value)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(value, pattern, group)

    def parts(pattern: str, database: Column, user: Column) -> Column:
        return F.struct(
            part(pattern, 1).alias("host"),
            part(pattern, 2).try_cast("bigint").alias("port"),
            database.alias("database"),
            user.alias("user"),
        )

    none = F.lit(None).cast("string")
    return reduce(
        lambda when, case: when.when(value.rlike(case[0]), parts(*case)),
        [(UI_URL, none, none), (JDBC_URL, part(JDBC_URL, 3), part(JDBC_URL, 4))],
        F.when(value.rlike(MASTER_URL), parts(MASTER_URL, none, none)),
    )


def canonical_name(
    name: Column | str,
    key: Column | str,
    adjectives: tuple[str, ...] = ADJECTIVES,
    nouns: tuple[str, ...] = NOUNS,
) -> Column:
    """Trimmed name, or ``adjective-noun-dddd`` fixed by the key where there is none."""
    key = _col(key).cast("bigint")
    trimmed = F.regexp_replace(_col(name), r"^\s+|\s+\z", "")
    size_a, size_n = len(adjectives), len(nouns)

    def pick(words: tuple[str, ...], index: Column) -> Column:
        return F.get(F.array(*map(F.lit, words)), F.pmod(index, F.lit(len(words))).cast("int"))

    generated = F.concat_ws(
        "-",
        pick(adjectives, key),
        pick(nouns, floor_div(key, size_a)),
        F.lpad(F.pmod(floor_div(key, size_a * size_n), F.lit(10000)).cast("string"), 4, "0"),
    )
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(generated)


# -- time ----------------------------------------------------------------------


def ms_to_ts(ms: Column | str) -> Column:
    """Epoch milliseconds as a zone-free timestamp of whole seconds."""
    return F.timestamp_seconds(floor_div(_col(ms), 1000)).cast("timestamp_ntz")


def ts_to_ms(ts: Column | str) -> Column:
    """Timestamp as epoch milliseconds; parts of a second are dropped."""
    return F.unix_seconds(_col(ts).cast("timestamp")) * 1000


def exact_ms(ts: Column | str) -> Column:
    """Timestamp as epoch milliseconds, milliseconds kept."""
    return F.unix_millis(_col(ts).cast("timestamp"))
