"""Column-level functions: parsing, cleaning, labels and bands."""

from firmscope.functions.clean import (  # noqa: F401
    activity_division,
    capital_band,
    capital_band_index,
    capital_unparsable,
    city_prefix,
    format_money_br,
    label_fallback,
    normalise_key,
    opening_date_ok,
    parse_code,
    parse_compact_date,
    parse_decimal_comma,
    parse_int,
    pct,
    quarantine_reason,
    round_half_up,
    scrub_chars,
    scrubbed_count,
    severity_badge,
)
