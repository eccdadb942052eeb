"""Pure Column expressions for parsing and labelling registry fields.

Every function returns a ``Column`` built from built-in Spark functions, so it
stays inside whole-stage code generation.  Parsing uses the ``try_*`` family:
under ANSI mode a bad value becomes null instead of failing the job.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmscope import schemas

ColumnOrName = Column | str

# A string of exactly eight digits.  ``\z`` (not ``$``) so that a trailing
# newline is rejected as well.
EIGHT_DIGITS = r"^[0-9]{8}\z"
COMPACT_DATE = "yyyyMMdd"
DAYS_PER_YEAR = 365.25
DEFAULT_DATE_FLOOR = "1900-01-01"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _date_lit(d: str | _dt.date | Column) -> Column:
    if isinstance(d, Column):
        return d
    return F.lit(d if isinstance(d, _dt.date) else _dt.date.fromisoformat(d))


def normalise_key(c: ColumnOrName, width: int = 8) -> Column:
    """Zero-pad a company key to ``width`` characters (longer values are cut)."""
    return F.lpad(_col(c), width, "0")


def parse_code(c: ColumnOrName) -> Column:
    """Text code -> bigint; empty or non-numeric text becomes null."""
    return F.nullif(_col(c), F.lit("")).try_cast("bigint")


def parse_int(c: ColumnOrName) -> Column:
    return F.nullif(_col(c), F.lit("")).try_cast("int")


def parse_decimal_comma(c: ColumnOrName, precision: int = 20, scale: int = 2) -> Column:
    """Decimal-comma text -> exact decimal; null or unparsable becomes 0."""
    t = f"decimal({precision},{scale})"
    parsed = F.replace(_col(c), F.lit(","), F.lit(".")).try_cast(t)
    return F.coalesce(parsed, F.lit(0).cast(t))


def capital_unparsable(c: ColumnOrName, precision: int = 20, scale: int = 2) -> Column:
    """True when a non-null value could not be parsed (it was replaced by 0)."""
    t = f"decimal({precision},{scale})"
    raw = _col(c)
    return raw.isNotNull() & F.replace(raw, F.lit(","), F.lit(".")).try_cast(t).isNull()


def parse_compact_date(c: ColumnOrName) -> Column:
    """``yyyyMMdd`` text -> date.  ``'0'``, ``''``, ``'00000000'`` and impossible
    calendar dates become null."""
    raw = F.nullif(_col(c), F.lit("0"))
    return F.try_to_date(raw, COMPACT_DATE)


def opening_date_ok(
    c: ColumnOrName,
    as_of: str | _dt.date | Column,
    floor: str | _dt.date = DEFAULT_DATE_FLOOR,
) -> Column:
    """Quarantine predicate: eight digits, a real date, within [floor, as_of].

    Never null: a null input counts as *not ok* (it is quarantined and counted).
    """
    raw = _col(c)
    d = F.try_to_date(raw, COMPACT_DATE)
    ok = raw.rlike(EIGHT_DIGITS) & d.between(_date_lit(floor), _date_lit(as_of))
    return F.coalesce(ok, F.lit(False))


#: What :func:`quarantine_reason` can say.
QUARANTINE_REASONS = ["missing", "malformed", "impossible_date", "before_floor", "after_as_of"]


def quarantine_reason(
    c: ColumnOrName,
    as_of: str | _dt.date | Column,
    floor: str | _dt.date = DEFAULT_DATE_FLOOR,
) -> Column:
    """Why an opening date is quarantined (null when it is accepted)."""
    raw = _col(c)
    d = F.try_to_date(raw, COMPACT_DATE)
    return (
        F.when(raw.isNull(), F.lit("missing"))
        .when(~raw.rlike(EIGHT_DIGITS), F.lit("malformed"))
        .when(d.isNull(), F.lit("impossible_date"))
        .when(d < _date_lit(floor), F.lit("before_floor"))
        .when(d > _date_lit(as_of), F.lit("after_as_of"))
    )


def scrub_chars(c: ColumnOrName, chars: str = "\x00") -> Column:
    """Remove every occurrence of the given characters."""
    return F.translate(_col(c), chars, "")


def scrubbed_count(c: ColumnOrName, chars: str = "\x00") -> Column:
    """How many characters ``scrub_chars`` removes from the value."""
    return F.length(_col(c)) - F.length(scrub_chars(c, chars))


def round_half_up(c: ColumnOrName, digits: int) -> Column:
    """Round half away from zero on the decimal value, as ``round(x::numeric)``.

    The value is first taken to an exact decimal, so a double such as 2.675
    rounds to 2.68 rather than to the nearest binary neighbour.
    """
    return F.round(_col(c).cast("decimal(38,10)"), digits).cast("double")


def activity_division(code: ColumnOrName, pad: int | None = 7) -> Column:
    """First two digits of an activity code.

    ``pad`` restores the leading zeros lost by storing the code as an integer
    (``111301`` -> ``'0111301'`` -> ``'01'``).  ``pad=None`` takes the first
    two characters of the integer text, which drops the leading zero.
    """
    text = _col(code).cast("string")
    if pad:
        text = F.lpad(text, pad, "0")
    return F.left(text, F.lit(2))


def city_prefix(code: ColumnOrName, n: int = 2) -> Column:
    """First ``n`` characters of a city code (a coarse region key)."""
    return F.left(_col(code).cast("string"), F.lit(n))


def label_fallback(description: ColumnOrName, code: ColumnOrName, prefix: str = "") -> Column:
    """Description when known, otherwise ``prefix || code``; null code -> null."""
    return F.coalesce(_col(description), F.concat(F.lit(prefix), _col(code).cast("string")))


def format_money_br(c: ColumnOrName, decimals: int = 2) -> Column:
    """Number text with ``.`` thousands and ``,`` decimals (``1.234,50``)."""
    return F.translate(F.format_number(_col(c), decimals), ",.", ".,")


def capital_band(
    c: ColumnOrName,
    edges: Sequence[float] = schemas.CAPITAL_BAND_EDGES,
    labels: Sequence[str] = schemas.CAPITAL_BAND_LABELS,
) -> Column:
    """Right-closed bands ``(e0, e1], (e1, e2], ..., (e_last, inf)``.

    Values at or below the first edge get null, like an interval cut.
    """
    if len(labels) != len(edges):
        raise ValueError("one label per lower edge is required")
    x = _col(c)
    expr = None
    for i, lo in enumerate(edges):
        cond = x > F.lit(lo)
        if i + 1 < len(edges):
            cond = cond & (x <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
    return expr


def capital_band_index(c: ColumnOrName, edges: Sequence[float] = schemas.CAPITAL_BAND_EDGES) -> Column:
    """1-based ordinal of ``capital_band`` (null outside the bands)."""
    x = _col(c)
    expr = None
    for i, lo in enumerate(edges):
        cond = x > F.lit(lo)
        if i + 1 < len(edges):
            cond = cond & (x <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(i + 1)) if expr is None else expr.when(cond, F.lit(i + 1))
    return expr


def severity_badge(pct: ColumnOrName) -> Column:
    ok, warn, critical = schemas.BADGE_LABELS
    p = _col(pct)
    return (
        F.when(p < F.lit(schemas.BADGE_OK_BELOW), F.lit(ok))
        .when(p < F.lit(schemas.BADGE_WARN_BELOW), F.lit(warn))
        .otherwise(F.lit(critical))
    )


def pct(numerator: ColumnOrName, denominator: ColumnOrName, digits: int) -> Column:
    """``round(100.0 * n / nullif(d, 0), digits)`` as a double.

    Computed in decimal arithmetic (14 fractional digits before rounding), so
    halves round away from zero exactly as numeric rounding does.
    """
    ratio = _col(numerator).cast("decimal(20,0)") * F.lit(100) / F.nullif(
        _col(denominator).cast("decimal(20,0)"), F.lit(0)
    )
    return F.round(ratio, digits).cast("double")
