"""Scalar text helpers: built-in expressions, but for packing texts that travel."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# Fixed values.
SNIPPET_CHARS = 200            # source snippet length
SNIPPET_ELLIPSIS = "..."
STORE_PREFIX = "streamlit_"     # store name = prefix + first 8 hex chars of md5(file name)
STORE_HASH_CHARS = 8
# Plain decimal number, as a strict numeric parser accepts it ('1d', '1f', 'nan' are not).
NUMERIC_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER_TEXT = r"^[+-]?[0-9]+$"
# ---------------------------------------------------------------------------------------

# Outer white space of any Unicode kind; inner runs are kept.
_OUTER_SPACE = r"(?U)^\s+|\s+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_outer(c: Column | str) -> Column:
    """Remove leading and trailing white space (tabs and Unicode spaces too)."""
    return F.regexp_replace(_c(c), _OUTER_SPACE, "")


def snippet(c: Column | str, n: int = SNIPPET_CHARS) -> Column:
    """First ``n`` characters, plus '...' when the text was longer."""
    t = _c(c)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit(SNIPPET_ELLIPSIS))).otherwise(t)


def _padded(pattern: str) -> str:
    # the same anchored pattern, allowing outer white space: prose fails at its first letter,
    # so long texts are rejected without being copied by a strip
    return "(?U)^\\s*" + pattern[1:-1] + "\\s*$"


def guarded_double(c: Column | str) -> Column:
    """Text → DOUBLE only for plain decimal numbers (after trimming); anything else NULL."""
    t = _c(c)
    return F.when(t.rlike(_padded(NUMERIC_TEXT)), strip_outer(t).try_cast("double"))


def guarded_long(c: Column | str) -> Column:
    t = _c(c)
    return F.when(t.rlike(_padded(INTEGER_TEXT)), strip_outer(t).try_cast("long"))


def money_text(c: Column | str, scale: int = 2) -> Column:
    """Number rendered with ``scale`` decimals, half-up; as plain text where DECIMAL cannot hold it."""
    x = _c(c)
    return F.coalesce(x.try_cast(f"decimal(38,{scale})").cast("string"), x.cast("string"))


def number_text(c: Column | str, dtype: T.DataType) -> Column:
    """A number as Python prints it: 12345678.9, 0.0001, 1e-05, 1e+16, 3.0; whole numbers without a point."""
    x = _c(c)
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return x.cast("string")
    text = x.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1)
    sign = F.when(power.startswith("-"), F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(digits, F.lit("e"), sign, F.lpad(F.regexp_replace(power, "-", ""), 2, "0"))
    size = F.abs(x)
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when((size == 0) | ((size >= 1e-4) & (size < 1e16)), F.when(size == 0, text).otherwise(plain))
            .otherwise(F.when(F.length(power) > 2, F.concat(digits, F.lit("e"), sign, F.regexp_replace(power, "-", "")))
                       .otherwise(scientific)))


def store_name(file_name: Column | str, prefix: str = STORE_PREFIX) -> Column:
    """Deterministic store name from a file name."""
    return F.concat(F.lit(prefix), F.substring(F.md5(_c(file_name)), 1, STORE_HASH_CHARS))


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def fill(template: str, **values: Column) -> Column:
    """A text template with ``{name}`` slots filled by columns (a NULL slot gives NULL)."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(values[piece].cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def rstrip_chars(c: Column | str, chars: str = ", ") -> Column:
    """Remove any trailing run of the given characters (like ``str.rstrip(chars)``)."""
    cls = "".join("\\" + ch if ch in "]\\^-" else ch for ch in chars)
    return F.regexp_replace(_c(c), f"[{cls}]+$", "")


def pack_text(c: Column | str) -> Column:
    """The bytes of a text, compressed: for texts that are sent to many rows (Spark's shuffle hardly shrinks prose)."""
    # plain UDFs: they hold a hundred rows at a time, whatever the texts grow to
    packed = F.udf(lambda b: None if b is None else zlib.compress(bytes(b)), "binary", useArrow=False)
    return packed(_c(c).cast("binary"))


def unpack_texts(c: Column | str, sep: str) -> Column:
    """An array of packed texts, joined by ``sep``; missing texts are skipped."""
    between = sep.encode()
    joined = F.udf(lambda a: None if a is None else between.join(zlib.decompress(bytes(b)) for b in a if b is not None), "binary", useArrow=False)
    return joined(_c(c)).cast("string")
