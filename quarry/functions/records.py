"""Column helpers for schema-less JSON records held as text.

Records are stored as ``body STRING`` (raw JSON) and parsed on demand into
``MAP<STRING,STRING>``; nested objects/arrays stay JSON text inside the map and
are parsed a second time where needed. No wide schema is ever inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import MISSING_MARKER, NONE_MARKER, bind

RECORD_MAP = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(RECORD_MAP)


def dedupe_keys(m: Column) -> Column:
    """Python dict semantics for duplicate JSON keys.

    The first occurrence keeps its position, the last occurrence supplies the
    value. The fast path (no duplicate) returns the map unchanged.
    """
    def fix(mm: Column) -> Column:
        keys = F.map_keys(mm)
        entries = F.map_entries(mm)
        firsts = F.filter(entries, lambda e, i: F.array_position(keys, e.key) == i + 1)
        merged = F.transform(
            firsts,
            lambda e: F.struct(
                e.key.alias("key"),
                F.element_at(F.filter(entries, lambda x: x.key == e.key), -1).value.alias("value"),
            ),
        )
        return F.when(F.size(F.array_distinct(keys)) == F.size(mm), mm).otherwise(F.map_from_entries(merged))

    return bind(m, fix)


def object_map(c: Column) -> Column:
    """JSON object text -> map that may repeat keys, null when ``c`` is not an object."""
    return F.when(c.rlike(r"^\s*\{"), F.from_json(c, RECORD_MAP))


def parse_object(c: Column) -> Column:
    """JSON object text -> deduplicated map, null when ``c`` is not an object."""
    return dedupe_keys(object_map(c))


def has_distinct_keys(m: Column) -> Column:
    """Whether ``dedupe_keys`` leaves ``m`` as it is; true of null. Unlike it this is compiled, so ``m`` should be a column."""
    return m.isNull() | (F.size(F.array_distinct(F.map_keys(m))) == F.size(m))


def with_objects(df: DataFrame, texts: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``: ``parse_object`` of each of ``texts``, as one array of maps.

    They are members of one JSON array, parsed in one go. Between them stand objects that hold the hash
    of all texts, which none of them holds: a text that is not exactly one object shows as an error or
    in these marks. ``name`` is null then, and where an object repeats a key: those texts must be parsed
    one by one. (The hash is a value, as the parser interns every key it meets.) Steps are columns of
    their own, as Spark evaluates the input of ``from_json`` without sharing parts.
    """
    n, kept = len(texts), df.columns
    parts = [f"_{name}_{i}" for i in range(n)]
    mark, parsed = f"_{name}_mark", f"_{name}_parsed"
    out = df.select("*", *[F.coalesce(F.when(t.rlike(r"^\s*\{"), t), F.lit("null")).alias(p) for t, p in zip(texts, parts, strict=True)])
    out = out.select("*", F.xxhash64(*parts).cast("string").alias(mark))
    between = F.concat(F.lit('{"mark":"'), F.col(mark), F.lit('"}'))
    members = [x for p in parts for x in (between, F.lit(","), F.col(p), F.lit(","))]
    out = out.select(*kept, mark, F.from_json(F.concat(F.lit('{"v":['), *members, between, F.lit("]}")),
                                              "v array<map<string,string>>, _corrupt_record string").alias(parsed))
    read = F.col(parsed)["v"]
    good = F.col(parsed)["_corrupt_record"].isNull() & (F.size(read) == 2 * n + 1)
    for i in range(n + 1):
        good = good & (F.get(read, F.lit(2 * i))["mark"] == F.col(mark))
    for i in range(n):
        good = good & has_distinct_keys(F.get(read, F.lit(2 * i + 1)))
    return out.select(*kept, F.when(good, F.array(*[F.get(read, F.lit(2 * i + 1)) for i in range(n)])).alias(name))


def parse_array(c: Column) -> Column:
    """JSON array text -> array<string>, null when ``c`` is not an array."""
    return F.when(c.rlike(r"^\s*\["), F.from_json(c, "array<string>"))


# ------------------------------------------------------------ typed values

# A member's text does not tell a JSON number or boolean from a string that looks like one.
# Where that matters the body is parsed once more, into VARIANT, which keeps the types.
LOOKS_TYPED = r"^-?\d+[.eE][\d.eE+-]*$|^(true|false)$"
LOOKS_FALSY = r"^-?0+(\.0*)?([eE][+-]?\d+)?$|^false$|^\s*\{\s*\}\s*$"


def typed_member(body: Column, key: Column) -> Column:
    """The member of a JSON object as VARIANT; null where there is none, or the body repeats a key."""
    return F.try_parse_json(body).try_cast("map<string,variant>")[key]


def float_text(d: Column) -> Column:
    """Python's ``str()`` of a float: its digits as the JVM prints them (the shortest ones, but for some
    values of 17 digits), an exponent below 1e-4 and from 1e16 on."""
    def place(parts: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(F.concat(parts.whole, parts.frac), "^0+(?=.)", ""), "(?<=.)0+$", "")
        led = F.length(F.regexp_extract(F.concat(parts.whole, parts.frac), "^0*", 0))  # leading zeros
        exp = F.length(parts.whole) - 1 - led + F.coalesce(parts.exp, F.lit(0))
        return bind(F.struct(digits.alias("d"), exp.alias("e"), parts.sign.alias("sign")), write)

    def write(x: Column) -> Column:
        n = F.length(x.d)
        plain = (F.when(x.e >= n - 1, F.concat(x.d, F.repeat(F.lit("0"), x.e - n + 1), F.lit(".0")))
                 .when(x.e >= 0, F.concat(F.substr(x.d, F.lit(1), x.e + 1), F.lit("."), F.substr(x.d, x.e + 2)))
                 .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -x.e - 1), x.d)))
        power = F.concat(F.when(x.e < 0, F.lit("e-")).otherwise(F.lit("e+")),
                         F.when(F.abs(x.e) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(x.e).cast("string"))
        tail = F.when(n > 1, F.concat(F.lit("."), F.substr(x.d, F.lit(2)))).otherwise(F.lit(""))
        short = F.concat(F.substr(x.d, F.lit(1), F.lit(1)), tail, power)
        return F.concat(x.sign, F.when(x.d == "0", F.lit("0.0")).when((x.e >= -4) & (x.e < 16), plain).otherwise(short))

    text = d.cast("string")
    parts = F.struct(F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"),
                     F.regexp_extract(text, r"^-?(\d+)", 1).alias("whole"), F.regexp_extract(text, r"\.(\d+)", 1).alias("frac"),
                     F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int").alias("exp"))
    return (F.when(F.isnan(d), F.lit("nan")).when(d == float("inf"), F.lit("inf")).when(d == float("-inf"), F.lit("-inf"))
            .otherwise(bind(parts, place)))


def python_text(value: Column, text: Column) -> Column:
    """Python's ``str()`` of a JSON scalar given as VARIANT; ``text`` for strings, nested values and null."""
    kind = F.schema_of_variant(value)
    number = value.try_cast("double")
    return (F.when(kind == "BOOLEAN", F.initcap(value.cast("string")))
            .when((kind == "DOUBLE") | (kind.startswith("DECIMAL") & text.rlike("[.eE]")), float_text(number))
            .otherwise(text))
