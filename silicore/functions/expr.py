"""Column expressions shared by views, reports and ingest. All are built-in
expressions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_COORD = -32768

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Character tables of the lot field, indexed by the encoded value.
LOT_HEAD = LETTERS.center(32, "_")
LOT_TAIL = ("0123456789" + LETTERS).center(64, "_")
FABS = {1: "TSMC1", 6: "TSMC2"}


def cols(names: str) -> list[str]:
    """Column names from one text."""
    return names.split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int | Column = 0) -> Column:
    """Round halves of the binary value, with a constant or a per-row number of digits."""
    scale = F.lit(float(10**digits)) if isinstance(digits, int) else F.pow(F.lit(10.0), digits.cast("double"))
    return F.round(col(c).cast("double") * scale) / scale


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as a double; null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def percent(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    return rounded(F.try_divide(F.lit(100.0) * col(part), col(whole).cast("double")), digits)


def finite(c: Column | str) -> Column:
    """True for a number, false for NaN and infinities, null for null."""
    return ~F.isnan(col(c)) & (F.abs(col(c)) < F.lit(float("inf")))


def good_count(flag: str = "passed") -> Column:
    return F.count(F.when(F.col(flag), 1))


def fail_count(flag: str = "passed") -> Column:
    return F.count(F.when(F.col(flag) == "F", 1))


def capability(mean: Column, sigma: Column, lo: Column, hi: Column) -> Column:
    """Cpk: the nearer limit's distance in units of three sigma; one-sided where a limit is null."""
    return F.least(F.try_divide(hi - mean, 3.0 * sigma), F.try_divide(mean - lo, 3.0 * sigma))


def package_text(prefix: str = "") -> Column:
    """The part of a die's identity that its bar code gives: only where it has no coordinates."""
    x, y, text = (F.col(prefix + c) for c in ("x_coord", "y_coord", "part_txt"))
    return F.when((x == NO_COORD) & (y == NO_COORD), text).otherwise(F.lit(""))


def sig_digits(c: Column, up: bool, digits: int = 3) -> Column:
    """c to so many significant digits, downwards or upwards."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))).cast("double") - float(digits - 1))
    whole = (F.ceil if up else F.floor)(c / step).cast("double")
    return F.when(c == 0, F.lit(0.0)).otherwise(whole * step)


def shown_digits(*parts: Column) -> Column:
    """Digits after the point that show the smallest of the given magnitudes, six at least."""
    least = F.least(*parts) if len(parts) > 1 else parts[0]
    return F.greatest(F.lit(6), F.lit(6) - F.floor(F.log10(least)).cast("int"))


def measured(units: bool = True) -> Column:
    """Rows that specification reviews look at: finite, between real limits, in volts or amperes."""
    ok = F.col("rec_type").isin("PTR", "MPR") & finite("result") & finite("lo_limit") & finite("hi_limit") & (F.col("lo_limit") < F.col("hi_limit"))
    return ok & F.upper(F.trim("units")).rlike("^.?[VA]$") if units else ok


def timestamp_from_unix(c: Column | str) -> Column:
    """Seconds since 1970 as a timestamp; not positive or null: 1970-01-01."""
    return F.timestamp_seconds(F.greatest(F.lit(0), F.coalesce(col(c), F.lit(0))))


def category(test_code: Column | str) -> Column:
    """CP for wafer probe codes (CP.., PT..), FT for final test, else OTHER."""
    c = F.upper(F.coalesce(col(test_code), F.lit("")))
    return F.when(c.startswith("CP") | c.startswith("PT"), "CP").when(c.startswith("FT"), "FT").otherwise("OTHER")


def revision(file_name: Column | str) -> Column:
    """The revision in a file name, such as Rev04, or an empty string."""
    return F.regexp_extract(col(file_name), r"(?i)[_\-](Rev\d+)[_\-.]", 1)


def path_safe(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"[\x00-\x1f\x7f]", ""), r'[|<>"?*:/\\]', "_"))


def _bits(c: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(c, start + 1, length), 2, 10).cast("bigint")


def decode_efuse(value: Column | str) -> dict[str, Column]:
    """Origin of a die from its 64-bit eFuse string (``0b`` before it allowed).

    From the most significant bit: fab 4, y 9, x 9, wafer 5 (less 3), lot 35 (one
    5-bit and five 6-bit characters), reserved 2. Anything but 64 binary digits is
    invalid: the raw value stays, all else is null.
    """
    raw = col(value)
    text = F.regexp_replace(F.trim(raw), "^0[bB]", "")
    valid = F.coalesce(text.rlike("^[01]{64}$"), F.lit(False))
    bits = F.when(valid, text)

    def letter(start: int, length: int, chars: str) -> Column:
        return F.substring(F.lit(chars), _bits(bits, start, length).cast("int") + 1, F.lit(1))

    fab = _bits(bits, 0, 4)
    name = F.lit(None).cast("string")
    for code, label in FABS.items():
        name = F.when(fab == code, label).otherwise(name)
    lot = F.concat(letter(27, 5, LOT_HEAD), *[letter(32 + 6 * i, 6, LOT_TAIL) for i in range(5)])
    return {
        "efuse_raw": F.coalesce(bits, raw),
        "valid": valid,
        "origin_fab_code": fab,
        "origin_fab": F.when(valid, F.coalesce(name, F.lit("UNSUPPORTED"))),
        "origin_lot": lot,
        "origin_wafer": _bits(bits, 22, 5) - 3,
        "origin_x": _bits(bits, 13, 9),
        "origin_y": _bits(bits, 4, 9),
        "reserved_bits": F.substring(bits, 63, 2),
    }
