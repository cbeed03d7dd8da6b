"""Scalar column expressions (all built-in, JVM side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regstat import config as cfg

# Characters removed by a JavaScript-style trim (white space and line
# terminators); Spark's ``trim`` only removes U+0020.
JS_SPACE_CODES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
                  *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
JS_SPACE_CHARS = "".join(chr(c) for c in JS_SPACE_CODES)
JS_SPACE = ("[\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
            "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]")
INT_PREFIX_PATTERN = f"^{JS_SPACE}*([+-]?[0-9]+)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _last_byte(x: Column) -> Column:
    """Last byte of a text's UTF-8 (empty for the empty text); a character
    would be counted out from the front."""
    return F.substring(x.cast("binary"), -1, 1)


def js_trim(c) -> Column:
    """Trim every JavaScript white-space character at both ends (a plain
    character-set trim, no regular expression). A text that starts and ends
    with visible ASCII has nothing to trim: a comparison at each end, where
    the trim searches the whole set."""
    x = col_(c)
    last = _last_byte(x)
    bare = ((x >= F.lit("!")) & (x < F.lit("\x7f"))
            & (last >= F.lit(b"!")) & (last < F.lit(b"\x7f")))
    return F.when(bare, x).otherwise(F.btrim(x, F.lit(JS_SPACE_CHARS)))


def clean_text(c, upper: bool = False) -> Column:
    """Trim, then drop every double quote, optionally upper-case.

    A null input becomes the empty string, as in the source.
    """
    x = js_trim(F.coalesce(col_(c), F.lit("")))
    out = F.when(F.contains(x, F.lit('"')), F.replace(x, F.lit('"'), F.lit(""))).otherwise(x)
    return F.upper(out) if upper else out


def clean_header(name: str) -> str:
    """Trim a header name and strip one pair of surrounding quotes."""
    name = name.strip()
    if name.startswith('"'):
        name = name[1:]
    if name.endswith('"'):
        name = name[:-1]
    return name


def lenient_int(c) -> Column:
    """Leading integer of a text ("45.7" -> 45, "12abc" -> 12, "" -> null).

    Plain integers take the cast (no regular expression); only cells that
    do not cast go through the prefix pattern. The cast is skipped when the
    text starts or ends with an ASCII control character, which the cast
    would strip but a JavaScript parse would not.
    """
    x = col_(c)
    plain = F.when((x >= F.lit("!")) & (_last_byte(x) >= F.lit(b"!")), x.try_cast("int"))
    prefix = F.regexp_extract(x, INT_PREFIX_PATTERN, 1).try_cast("int")  # no digits: "", which casts to null
    return F.coalesce(plain, prefix)


def lenient_number(c) -> Column:
    """C4: numeric value of a cell, 0 when it is not a number (words such as
    NaN or Infinity and suffixed literals such as ``1d`` are not numbers)."""
    x = F.trim(col_(c).cast("string"))
    plain = x.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    value = F.when(plain, x.try_cast("double"))
    return F.coalesce(F.when(F.abs(value) < F.lit(9.2e18), value), F.lit(0.0))


def age_band(age, unknown: str = cfg.UNKNOWN) -> Column:
    """Age band by upper bounds (negative ages fall in the first band)."""
    a = col_(age)
    expr = F.when(a.isNull(), F.lit(unknown))
    for bound, label in zip(cfg.AGE_BAND_UPPER_BOUNDS, cfg.AGE_BANDS):
        expr = expr.when(a <= bound, F.lit(label))
    return expr.otherwise(F.lit(cfg.AGE_BANDS[-1]))


def quarter(month) -> Column:
    """quarter = ceil(month / 3)."""
    return F.ceil(col_(month) / F.lit(3)).cast("int")


def round_half_up(x, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d (ties go up, as in the source).

    With ``digits == 0`` the result is a bigint, else a double.
    """
    x = col_(x)
    if digits == 0:
        return F.floor(x + F.lit(0.5)).cast("bigint")
    scale = 10 ** digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def crude_rate(cases, population, scale: int = cfg.RATE_SCALE) -> Column:
    """C17: cases per ``scale`` inhabitants, 2 digits, 0 without population."""
    raw = col_(cases) / F.nullif(col_(population), F.lit(0)) * F.lit(scale)
    return F.coalesce(round_half_up(raw, 2), F.lit(0.0))


def rate_hundredths(cases, population, scale: int = cfg.RATE_SCALE) -> Column:
    """Crude rate x 100 as an exact bigint (null without population)."""
    raw = col_(cases) / F.nullif(col_(population), F.lit(0)) * F.lit(scale)
    return F.floor(raw * F.lit(100) + F.lit(0.5)).cast("bigint")


def share_pct(part, total) -> Column:
    """Integer percentage, 0 when the total is 0."""
    return F.coalesce(
        round_half_up(col_(part) / F.nullif(col_(total), F.lit(0)) * F.lit(100), 0),
        F.lit(0).cast("bigint"))


def month_label(month) -> Column:
    """C14: month number -> short label, ``M{n}`` outside 1..12."""
    labels = F.array(*[F.lit(x) for x in cfg.MONTH_LABELS])
    m = col_(month)
    return F.coalesce(F.get(labels, m - F.lit(1)), F.concat(F.lit("M"), m.cast("string")))


def thousands(n) -> Column:
    """Integer with en-US thousands separators."""
    return F.format_number(col_(n), 0)


def js_number(x, digits: int) -> Column:
    """Text of a value already rounded to ``digits`` decimals, printed the
    way JavaScript prints numbers (no trailing zeros: 60.1, 5, 62.19)."""
    fixed = F.format_string(f"%.{digits}f", col_(x))
    if digits == 0:
        return fixed
    return F.regexp_replace(fixed, "\\.?0+$", "")


def json_string(c) -> Column:
    """A JSON string literal of a text column (quotes, backslashes and
    control characters escaped; null gives ``null``)."""
    listed = F.to_json(F.array(col_(c)))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def template(tpl: str, **values) -> Column:
    """Fill a ``{name}`` template with columns (or plain strings) as one
    ``concat``; every value is cast to string."""
    import string
    parts = []
    for literal, field, _, _ in string.Formatter().parse(tpl):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            v = values[field]
            parts.append(F.lit(v) if isinstance(v, str) else v.cast("string"))
    return F.concat(*parts)
