"""Column -> Column text kernels.

Everything here is a pure Spark expression (no Python UDF), so it stays inside
whole-stage codegen and can be used in filters, joins and higher-order lambdas.

Semantics follow Python's ``str`` behaviour where the scored data depends on it:
``strip``/``split`` whitespace, ``float()`` parsing, and NFKD-to-ASCII folding.
The folding tables are *generated* from ``unicodedata`` at first use.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Fixed values that must equal the reference semantics.
# --------------------------------------------------------------------------
NA_MARKER = "N/A"          # valid "not applicable"
MISSING_MARKER = "MISSING"  # key absent from a prediction
NONE_MARKER = "None"        # JSON null rendered through str()
NUMERIC_RTOL = 0.01
NUMERIC_ATOL = 1e-4



def _java_class(chars: list[str]) -> str:
    """Render code points as a Java regex character class, compressing runs."""
    cps = sorted(ord(c) for c in chars)
    parts, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        lo, hi = cps[i], cps[j]
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
        i = j + 1
    return "[" + "".join(parts) + "]"


@lru_cache(maxsize=None)
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """Per-code-point NFKD -> ASCII tables.

    Returns (from_chars, to_chars, multi) where ``translate(s, from, to)``
    handles every code point that folds to exactly one ASCII char and
    ``multi`` maps code points that fold to several ASCII chars. Code points
    folding to nothing are removed afterwards by stripping non-ASCII.
    """
    src, dst, multi = [], [], {}
    for cp in range(128, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
        if len(folded) == 1:
            src.append(ch)
            dst.append(folded)
        elif len(folded) > 1:
            multi[ch] = folded
    return "".join(src), "".join(dst), multi


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` as a lambda variable.

    Spark neither de-duplicates repeated sub-expressions inside higher-order
    functions nor keeps plans small when a large expression is referenced
    several times; binding through a one-element array does both.
    """
    return F.transform(F.array(value), fn)[0]


# Python's str.isspace() set: Java's Unicode White_Space plus \x1c-\x1f.
_PY_WS = r"[\s\x1c-\x1f]"
_PY_WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_ASCII_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f ]"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(c, F.lit(_PY_WS_CHARS))


def _fold(s: Column) -> Column:
    src, dst, multi = fold_tables()
    # One literal node (folded to a map constant) instead of 2x445 children.
    multi_map = F.from_json(F.lit(json.dumps(multi)), "map<string,string>")
    expanded = F.when(
        s.rlike(_java_class(list(multi))),
        F.array_join(F.transform(F.split(s, ""), lambda ch: F.coalesce(multi_map[ch], ch)), ""),
    ).otherwise(s)
    folded = F.when(
        s.rlike(r"[^\x00-\x7F]"),
        F.regexp_replace(F.translate(expanded, src, dst), r"[^\x00-\x7F]", ""),
    ).otherwise(s)
    collapsed = F.regexp_replace(F.lower(folded), f"{_ASCII_WS}+", " ")
    return F.btrim(collapsed, F.lit(" "))


def _clean_ascii(s: Column) -> Column:
    """Printable ASCII words separated by single spaces: already in normal form
    except for case, so the fold reduces to ``lower``. (A pattern with a repeated group
    would say it in one go, but Java matches such a group by recursion.)"""
    return (s == "") | (s.rlike("^[ -~]+$") & ~s.contains("  ") & ~s.startswith(" ") & ~s.endswith(" "))


def _normalise(s: Column) -> Column:
    return F.when(_clean_ascii(s), F.lower(s)).otherwise(_fold(s))


def normalise_string(c: Column, bound: bool = True) -> Column:
    """NFKD -> drop non-ASCII -> lower -> collapse whitespace (Python split/join).

    ``bound`` evaluates ``c`` once through a lambda — needed inside higher-order
    functions; row-level projections pass ``bound=False`` and stay in codegen,
    where Spark removes the repeated sub-expressions itself.
    """
    return bind(c, _normalise) if bound else _normalise(c)


def is_na(c: Column) -> Column:
    """``str(v).strip().upper() == 'N/A'``."""
    return c.contains("/") & ((c == NA_MARKER) | (F.upper(py_strip(c)) == F.lit(NA_MARKER)))


# float() literal: decimal with optional exponent, inf/infinity/nan, signed,
# surrounded by any Python whitespace (ASCII digits only; no underscores).
NUMERIC_GATE = (f"(?U)^{_PY_WS}*[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?"
                f"|(?i:inf|infinity|nan)){_PY_WS}*$")


_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_numeric(c: Column) -> Column:
    """Python ``float(s.strip())`` or null for N/A, blank and junk."""
    # Spark accepts '1d'/'1f' and rejects '+nan'; the gate and the sign strip fix both.
    unsigned_nan = F.regexp_replace(py_strip(c), "^[+-](?=[nN])", "")
    lowered = F.lower(c)
    maybe = c.rlike("[0-9]") | lowered.contains("inf") | lowered.contains("nan")
    return (F.when(c.rlike(_PLAIN_NUMBER), c.try_cast("double"))
            .when(maybe & c.rlike(NUMERIC_GATE), unsigned_nan.try_cast("double")))


def numeric_close(p: Column, g: Column, rtol: float = NUMERIC_RTOL, atol: float = NUMERIC_ATOL,
                  bound: bool = True, either: bool = False) -> Column:
    """``|p - g| <= atol + rtol*|g|`` with Python NaN semantics (NaN never close).

    ``either`` accepts a difference within the relative or the absolute tolerance instead.
    """
    def close(d: Column) -> Column:
        within = (d <= F.lit(rtol) * F.abs(g)) | (d <= F.lit(atol)) if either else d <= F.lit(atol) + F.lit(rtol) * F.abs(g)
        return within & ~F.isnan(d)
    return bind(F.abs(p - g), close) if bound else close(F.abs(p - g))


def name_key(c: Column) -> Column:
    """Fuzzy file-name key — drop ':', '/', ' ' and lower-case."""
    return F.lower(F.translate(c, ":/ ", ""))


def file_stem(c: Column) -> Column:
    """Path(name).stem: text after the last '/', minus the last suffix."""
    base = F.element_at(F.split(c, "/"), -1)
    pattern = r"^(.+)\.[^.]+$"
    return F.when(base.rlike(pattern), F.regexp_extract(base, pattern, 1)).otherwise(base)


def stem_candidates(c: Column) -> Column:
    """[stem, stem without ':', stem without leading zeros (or '0')]."""
    stem = file_stem(c)
    return F.array(
        stem,
        F.replace(stem, F.lit(":"), F.lit("")),
        F.coalesce(F.nullif(F.regexp_replace(stem, "^0+", ""), F.lit("")), F.lit("0")),
    )


def truncate(c: Column, n: int) -> Column:
    """Keep the first ``n`` characters (error messages, listings)."""
    return F.substring(c, 1, n)


def strict_json_object(c: Column) -> Column:
    """True when ``c`` is exactly one JSON object (no junk, no single quotes).

    ``from_json`` alone accepts trailing junk. As the first of two members of an object,
    ``c`` must end exactly where the second begins: anything behind it breaks the syntax,
    ends the object too early, or shows as a further key. The second key is a hash of
    ``c``, which ``c`` does not hold itself. As Python's ``json.loads`` does.
    """
    end = F.xxhash64(c).cast("string")
    members = F.from_json(F.concat(F.lit('{"v":'), c, F.lit(',"'), end, F.lit('":1}')), "map<string,string>",
                          {"allowSingleQuotes": "false", "allowNumericLeadingZeros": "false",
                           "allowUnquotedControlChars": "false", "mode": "PERMISSIVE"})
    return c.rlike(r"^\s*\{") & F.coalesce(F.map_keys(members) == F.array(F.lit("v"), end), F.lit(False))


def exact_mean(x: Column, digits: int = 15) -> Column:
    """Order-independent mean: decimal sum, one division at the end.

    A plain double ``avg`` depends on the order partial sums are combined, so two runs with
    different partitioning can differ in the last bits. The decimal sum has ``digits``
    places after the point and 38 in all, enough for 1e22 values of at most 1.
    """
    return exact_sum(x, digits) / F.count(x).cast("double")


def exact_sum(x: Column, digits: int = 15) -> Column:
    """Order-independent sum of doubles, as decimals with ``digits`` places."""
    return F.sum(x.cast(f"decimal(38,{digits})")).cast("double")
