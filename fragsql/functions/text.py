"""Text functions as column expressions, all in the JVM. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blank at both ends of a text.
BLANKS = " \t\n\r\f\v"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column, chars: str = BLANKS) -> Column:
    return F.btrim(_c(c), F.lit(chars))


def strip_start(c: str | Column, chars: str = BLANKS) -> Column:
    return F.ltrim(_c(c), F.lit(chars))


def strip_end(c: str | Column, chars: str = BLANKS) -> Column:
    return F.rtrim(_c(c), F.lit(chars))


def is_number(c: str | Column) -> Column:
    """Whether a text is a number as source code writes it: hex after 0x, or decimal with fraction, exponent, and a
    type letter d, f or (without exponent) l. Only a minus may stand first. A point needs a digit before or after.
    Null and the empty text aren't numbers."""
    number = r"^-?(0x[0-9a-fA-F]+|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+[dDfF]?|[dDfFlL])?)$"
    # a number can't end with its point
    return F.coalesce(_c(c).rlike(number) & ~_c(c).endswith("."), F.lit(False))


def count_matches(c: str | Column, sub: str) -> Column:
    """How often sub occurs, not overlapping; 0 for null, the empty text and the empty sub."""
    if not sub:
        return F.lit(0)
    gone = F.length(F.replace(_c(c), F.lit(sub), F.lit("")))
    return F.coalesce(((F.length(_c(c)) - gone) / len(sub)).cast("int"), F.lit(0))


def nth_index(c: str | Column, ch: str, nth: int) -> Column:
    """The place (from 0) of the nth occurrence of a character, -1 if there are fewer."""
    if nth < 1:
        raise ValueError("nth must be at least 1")
    return F.when(count_matches(c, ch) < nth, F.when(_c(c).isNotNull(), -1)).otherwise(F.length(F.substring_index(_c(c), ch, nth)))


def encode_hex(c: str | Column) -> Column:
    """Upper-case hex digits of the bytes."""
    return F.hex(_c(c).cast("binary"))


def decode_hex(c: str | Column) -> Column:
    """Bytes of hex digits; null for a text that isn't hex."""
    return F.when(_c(c).rlike("^([0-9a-fA-F]{2})*$"), F.unhex(_c(c)))


def escape(c: str | Column) -> Column:
    """Control characters, quotes, backslashes and everything outside ASCII as source code escapes them."""
    # fixed values: the short escapes
    short = {"\b": "\\b", "\n": "\\n", "\t": "\\t", "\f": "\\f", "\r": "\\r", "'": "\\'", '"': '\\"', "\\": "\\\\"}

    def one(ch: Column) -> Column:
        out = F.lit(None).cast("string")
        for plain, escaped in short.items():
            out = F.coalesce(out, F.when(ch == plain, F.lit(escaped)))
        code = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        unit = F.concat(F.lit("\\u"), F.substring(code, 1, 4), F.when(F.length(code) > 4, F.concat(F.lit("\\u"), F.substring(code, 5, 4))).otherwise(""))
        return F.coalesce(out, F.when((F.ascii(ch) < 32) | (F.ascii(ch) > 127), unit).otherwise(ch))

    return F.when(_c(c) == "", "").otherwise(F.array_join(F.transform(F.split(_c(c), ""), one), ""))


def display_bytes(c: str | Column) -> Column:
    """A size in bytes, kB, MB or GB of 1024 each, with two decimals beyond bytes."""
    n = _c(c)
    big = F.abs(n)
    shown = lambda unit, name: F.format_string(f"%.2f {name}", n / F.lit(float(unit)))
    return F.when(big < 1024, F.format_string("%d bytes", n)).when(big < 1 << 20, shown(1 << 10, "kB")).when(big < 1 << 30, shown(1 << 20, "MB")).when(n.isNotNull(), shown(1 << 30, "GB"))


def format_millis(c: str | Column) -> Column:
    """Hours, minutes, seconds and milliseconds of a time span, those that are 0 left out; 0ms if all are."""
    t = _c(c).cast("long")
    parts = [(F.floor(t / 3_600_000), "h "), (F.floor(t % 3_600_000 / 60_000), "m "), (F.floor(t % 60_000 / 1000), "s "), (t % 1000, "ms")]
    text = F.concat(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("") for n, unit in parts])
    return F.when(t.isNotNull(), F.when(text == "", "0ms").otherwise(text))


def to_bits(c: str | Column, width: int = 64) -> Column:
    """The binary digits of a number, filled up with zeros from the left; a negative one in two's complement."""
    return F.right(F.lpad(F.bin(_c(c)), 64, "0"), F.lit(width))
