"""PDF syntax and page arithmetic as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ..kernel.fonts import WINANSI, widths
from ..kernel.layout import ENTITIES


def literal_string(text: Column) -> Column:
    """A literal string: backslash, parentheses, CR and NUL escaped."""
    for a, b in (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\r", "\\r"), ("\0", "\\000")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit("("), text, F.lit(")"))


def hex_string(raw: Column) -> Column:
    return F.concat(F.lit("<"), F.lower(F.hex(raw)), F.lit(">"))


def text_string(text: Column) -> Column:
    """ASCII as a literal string, else UTF-16 with its mark, in hexadecimal."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("<feff"), F.lower(F.hex(F.encode(text, "UTF-16BE"))), F.lit(">"))).otherwise(literal_string(text))


def name(text: Column) -> Column:
    """A name: bytes outside the regular ones, and #, as #XX."""
    plain = text.rlike(r"^[!-~&&[^#/%()<>\[\]{}]]*$")
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    regular = [f"{c:02X}" for c in range(0x21, 0x7F) if chr(c) not in "#/%()<>[]{}"]
    spelled = F.transform(pairs, lambda x: F.when(x.isin(regular), F.chr(F.conv(x, 16, 10).cast("int"))).otherwise(F.concat(F.lit("#"), x)))
    return F.concat(F.lit("/"), F.when(plain, text).otherwise(F.array_join(spelled, "")))


def classic_record(off: Column, gen: Column, free: Column) -> Column:
    """A cross-reference record of 20 characters."""
    return F.concat(F.lpad(off.cast("string"), 10, "0"), F.lit(" "), F.lpad(gen.cast("string"), 5, "0"), F.when(free, " f\r\n").otherwise(" n\r\n"))


def unescape_entities(text: Column) -> Column:
    """The four entities of the markup dialect; &amp; last, so nothing is read twice."""
    for a, b in ENTITIES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\r\\x0b\\f]+"), lambda w: w != "")


def strip_tags(markup: Column) -> Column:
    """Markup without its tags, which never part words; a < without a > stays."""
    return F.regexp_replace(markup, "<[^>]*>", "")


def hex_color(text: Column) -> dict[str, Column]:
    """r, g, b of #rrggbb; anything else is black."""
    ok = text.rlike("^#[0-9a-fA-F]{6}([0-9a-fA-F]{2})?$")
    return {c: F.when(ok, F.conv(F.substring(text, at, 2), 16, 10).cast("int")).otherwise(0) for c, at in (("r", 2), ("g", 4), ("b", 6))}


def winansi(text: Column) -> Column:
    """The text with a question mark for each character that WinAnsi lacks."""
    return F.regexp_replace(text, "[^" + "".join(rf"\x{{{ord(c):x}}}" for c in sorted(WINANSI)) + r"\t\n\r\x0b\f]", "?")


def string_width(text: Column, font: str = "Helvetica") -> Column:
    """The sum of a text's advance widths, in thousandths of the size."""
    table = F.array(*map(F.lit, widths(font)))
    high = {c: k for c, k in WINANSI.items() if k >= 0x80}
    at = lambda c: F.when(F.ascii(c).between(0x20, 0x7E), F.ascii(c)).otherwise(F.coalesce(F.try_element_at(F.create_map(*(x for c2, k in high.items() for x in (F.lit(c2), F.lit(k)))), c), F.lit(0x3F)))
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", 0).otherwise(F.element_at(table, at(c) + 1)))


def affine(m: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return x * a + y * c + e, x * b + y * d + f


def bounding_box(points: list[tuple[Column, Column]]) -> dict[str, Column]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def fnv_fold(numbers: Column) -> Column:
    """FNV-1a over an array of numbers, in 32 bits."""
    return F.aggregate(numbers, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x.cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def pdf_date(t: Column, minutes: int = 0) -> Column:
    sign = "-" if minutes < 0 else "+"
    return F.concat(F.lit("D:"), F.date_format(t, "yyyyMMddHHmmss"), F.lit(f"{sign}{abs(minutes) // 60:02d}'{abs(minutes) % 60:02d}'"))


def location(kind: Column, off: Column, stm: Column, idx: Column) -> Column:
    """Where a record points, for reading: @0x..., objstm N[i] or free."""
    return F.when(kind == "normal", F.concat(F.lit("@0x"), F.lower(F.hex(off)))).when(kind == "compressed", F.concat(F.lit("objstm "), stm, F.lit("["), idx, F.lit("]"))).otherwise(F.lit("free"))


def shown_bytes(raw: Column) -> Column:
    """Bytes for a terminal: printable ones as they are, others as \\xNN."""
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))
    printable = [f"{c:02X}" for c in range(0x20, 0x7F) if c != 0x5C]
    return F.array_join(F.transform(pairs, lambda x: F.when(x.isin(printable), F.chr(F.conv(x, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\x"), F.lower(x)))), "")


@F.pandas_udf(LongType())
def adler32(raw: pd.Series) -> pd.Series:
    """The checksum of a zlib stream, in C over Arrow batches (an expression over single bytes would be interpreted)."""
    import zlib

    return raw.map(lambda b: None if b is None else zlib.adler32(bytes(b)))


@F.pandas_udf(BinaryType())
def inflate(raw: pd.Series) -> pd.Series:
    """Inflated bytes; null for a stream that is bad or cut."""
    from ..kernel.errors import PdfError
    from ..kernel.flate import inflate as one

    def safe(b):
        try:
            return None if b is None else one(bytes(b))
        except PdfError:
            return None

    return raw.map(safe)
