"""Secret scan: fixed credential patterns plus sliding-window entropy, built-in functions only.

Three pattern kinds find their leftmost non-overlapping matches in the whole text. The
entropy kinds add spans: for each character class, candidate strings are runs of the class;
a window slides over a candidate one character at a time, updating the character counts and
the running sum of c*log2(c) by the character that enters and the one that leaves, and the
span from the first to the last window above the class's threshold is reported. Candidates
that match an allow-list pattern are suppressed; pattern matches are never suppressed.

Positions are code points, end exclusive, and the scan never leaves the row: no shuffle.
Null text counts as empty; repeated rows and null ids are returned as they come; other
columns are ignored and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern kinds in report order (name, pattern, measured group, least length).
# A run of one class that is too short holds no longer match, so the least lengths of access
# and hex stand in the pattern; a failing assign match still uses up its characters.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class EntropyClass:
    """A character class: candidate run, window, and least bits per character of a window."""
    name: str
    alphabet: str
    run: str
    window: int
    bits: float


ENTROPY_CLASSES = (
    EntropyClass("entropy_hex", "0123456789abcdefABCDEF", r"[0-9A-Fa-f]{24,}", 24, 3.05),
    EntropyClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-",
                 r"[A-Za-z0-9+/=_-]{20,}", 20, 3.65),
)
# Plain words, plain numbers, hyphenated or slashed words, and placeholders are no secrets.
ALLOWED = (r"^[A-Za-z]+$", r"^[0-9]+$", r"^[A-Za-z][A-Za-z/_=+-]*$", r"(?i)example|sample|placeholder|xxxx",
           r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", r"^[-=_+/]+$")

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_MATCH = "array<struct<start:bigint,kind:int,end:bigint,value:string,part:string>>"
BLOCK = 64


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end, value>>.

    The pieces between matches and the matches themselves alternate, so positions are
    running sums of their lengths. Matches whose ``group`` is shorter than ``least`` drop out
    after matching, because they still use up their characters.
    """
    found = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    none = F.array().cast(_MATCH)
    kept = F.filter(_placed(F.filter(found, lambda x: x["value"].isNotNull()), kind), lambda x: F.length(x["part"]) >= least)
    return F.when(text.rlike(pattern), kept).otherwise(none)


def _bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``fn``."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _placed(found: Column, kind: int) -> Column:
    """``found`` (gap, value, part) with positions. An array grown one by one is copied each time, so
    positions run inside blocks of ``BLOCK`` matches, and over the blocks' totals."""
    def length(x: Column) -> Column:
        return (x["gap"] + F.length(x["value"])).cast("bigint")

    def place(acc: Column, x: Column) -> Column:
        start = (acc["pos"] + x["gap"]).cast("bigint")
        end = (acc["pos"] + length(x)).cast("bigint")
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"), x["part"].alias("part"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    def first_places(rows: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(rows) / BLOCK).cast("int"), F.lit(1)) - 1)
        totals = F.transform(blocks, lambda b: F.aggregate(
            F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("bigint"), lambda acc, x: acc + length(x)))
        return F.aggregate(
            totals, F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<bigint>").alias("out")),
            lambda acc, n: F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")),
            lambda acc: acc["out"])

    def in_blocks(rows: Column) -> Column:
        return _bind(first_places(rows), lambda places: F.flatten(F.transform(places, lambda pos, b: F.aggregate(
            F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)), F.struct(pos.alias("pos"), F.array().cast(_MATCH).alias("out")),
            place, lambda acc: acc["out"]))))

    return _bind(found, in_blocks)


def hot_stretch(value: Column, cls: EntropyClass) -> Column:
    """(first, last) start of the windows of ``value`` that reach the class's entropy; null if none."""
    w, size = cls.window, len(cls.alphabet)
    limit = w * (math.log2(w) - cls.bits) + 1e-9  # entropy >= bits  <=>  sum c*log2(c) <= limit
    terms = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(w + 2)])
    codes = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(cls.alphabet), ch))
    moves = _bind(codes, lambda cs: F.transform(cs, lambda c, i: F.struct(  # 1-based codes; 0: nothing leaves yet
        c.alias("enters"), F.coalesce(F.get(cs, i - w), F.lit(0)).alias("leaves"), (i + 1 - w).alias("start"))))

    def step(acc: Column, x: Column) -> Column:
        c_in, c_out = F.get(acc["counts"], x["enters"]), F.get(acc["counts"], x["leaves"])
        change = F.when(x["enters"] == x["leaves"], F.lit(0.0)).otherwise(
            F.get(terms, c_in + 1) - F.get(terms, c_in)
            + F.when(x["leaves"] > 0, F.get(terms, c_out - 1) - F.get(terms, c_out)).otherwise(F.lit(0.0)))
        counts = F.transform(acc["counts"], lambda c, k: c + (k == x["enters"]).cast("int") - (k == x["leaves"]).cast("int"))
        return F.struct(counts.alias("counts"), (acc["total"] + change).alias("total"),
                        acc["first"].alias("first"), acc["last"].alias("last"), x["start"].alias("start"))

    def seen(acc: Column) -> Column:
        hit = (acc["start"] >= 0) & (acc["total"] <= limit)
        return F.struct(acc["counts"].alias("counts"), acc["total"].alias("total"),
                        F.when(hit, F.least(acc["first"], acc["start"])).otherwise(acc["first"]).alias("first"),
                        F.when(hit, F.greatest(acc["last"], acc["start"])).otherwise(acc["last"]).alias("last"),
                        acc["start"].alias("start"))

    none = F.lit(None).cast("int")
    return F.aggregate(
        moves,
        F.struct(F.array_repeat(F.lit(0), size + 1).alias("counts"), F.lit(0.0).alias("total"),
                 none.alias("first"), none.alias("last"), none.alias("start")),
        lambda acc, x: F.get(F.transform(F.array(step(acc, x)), seen), F.lit(0)),
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropy_spans(text: Column, cls: EntropyClass, kind: int, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of high entropy inside the class's candidate runs, allow-listed candidates left out."""
    suspects = F.filter(matches(text, cls.run, kind),
                        lambda x: ~F.array_contains(F.array(*[x["value"].rlike(p) for p in allowed]), True))
    measured = F.transform(suspects, lambda x: F.struct(x["start"].alias("start"),
                                                        hot_stretch(x["value"], cls).alias("hit")))
    return F.transform(
        F.filter(measured, lambda x: x["hit"]["first"].isNotNull()),
        lambda x: F.struct((x["start"] + x["hit"]["first"]).cast("bigint").alias("start"), F.lit(kind).alias("kind"),
                           (x["start"] + x["hit"]["last"] + cls.window).cast("bigint").alias("end")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 classes: tuple[EntropyClass, ...] = ENTROPY_CLASSES,
                 allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per document: ``base`` and ``found``, arrays of (start, kind, end), plus ``kinds``.

    ``base`` has the pattern matches, ``found`` these and the entropy spans, both in order
    of start and kind; ``kind`` is an index into ``kind_names(classes)``.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    base = [F.transform(matches(F.col("_text"), p, k, g, n),
                        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
            for k, (_, p, g, n) in enumerate(PATTERNS)]
    extra = [entropy_spans(F.col("_text"), c, len(PATTERNS) + k, allowed) for k, c in enumerate(classes)]
    rows = docs.select(docs[id_col].alias("_id"), text.alias("_text"))
    return (rows.select("_id", F.concat(*base).cast(_SPAN).alias("_base"),
                        (F.concat(*extra) if extra else F.array()).cast(_SPAN).alias("_extra"))
            .select(F.col("_id").alias(id_col), F.array_sort("_base").alias("base"),
                    F.array_sort(F.concat("_base", "_extra")).alias("found")))


def kind_names(classes: tuple[EntropyClass, ...] = ENTROPY_CLASSES) -> list[str]:
    return [p[0] for p in PATTERNS] + [c.name for c in classes]


def spans_text(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(n) for n in names]), x["kind"] + 1), x["start"], x["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per pattern kind, digest of the pattern spans, and all spans as text."""
    names = kind_names()
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return scan_secrets(docs, id_col, text_col).select(
        id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base"), names).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("found"), names).alias("spans"))
