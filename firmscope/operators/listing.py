"""Listing, ranking and saved segments.

Filters on sector and city compare the *descriptions* of the two lookups, with
values always passed as literals (never spliced into SQL text), so an input
such as ``"' OR '1'='1"`` only matches a description spelled that way.
``None`` (or the wildcard words) means no filter.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope import schemas
from firmscope.operators import ranges
from firmscope.operators.aggregates import mean_money

LISTING_COLUMNS = ["company_id", "legal_name", "share_capital", "opened_on", "sector", "city"]


def _wild(value: str | None, wildcard: str) -> str | None:
    return None if value is None or value == wildcard else value


def companies_labelled(
    companies: DataFrame, ref_activity: DataFrame, ref_city: DataFrame, positive_capital: bool = True
) -> DataFrame:
    """Companies with sector and city descriptions (two left lookups, J3)."""
    base = companies.where(F.col("share_capital") > 0) if positive_capital else companies
    a = ref_activity.select(F.col("code").alias("_a_code"), F.col("description").alias("sector"))
    c = ref_city.select(F.col("code").alias("_c_code"), F.col("description").alias("city"))
    return (
        base.join(a, base.activity_code == a._a_code, "left")
        .join(c, base.city_code == c._c_code, "left")
        .drop("_a_code", "_c_code")
    )


def companies_filtered(
    companies: DataFrame,
    ref_activity: DataFrame,
    ref_city: DataFrame,
    sector: str | None = None,
    city: str | None = None,
) -> DataFrame:
    """Companies with positive capital, optionally one sector and/or one city (P10)."""
    sector = _wild(sector, schemas.ANY_SECTOR)
    city = _wild(city, schemas.ANY_CITY)
    df = companies_labelled(companies, ref_activity, ref_city)
    if sector is not None:
        df = df.where(F.col("sector") == F.lit(sector))
    if city is not None:
        df = df.where(F.col("city") == F.lit(city))
    return df.select(*LISTING_COLUMNS)


def _total_order(first: Sequence[Column], columns: Sequence[str]) -> list[Column]:
    """Primary sort keys followed by every output column, so ties between rows
    that differ anywhere are broken and the selected rows are deterministic."""
    return list(first) + [F.col(c).asc_nulls_last() for c in columns]


#: Own columns of the companies table; the lookups are joined to the chosen rows only.
PREVIEW_ORDER = ["opened_on", "company_id", "legal_name", "share_capital", "activity_code", "city_code"]


def opening_days(companies: DataFrame) -> DataFrame:
    """Companies with positive capital per opening date: the side table of :func:`companies_preview` (a row for each date)."""
    dated = companies.where((F.col("share_capital") > 0) & F.col("opened_on").isNotNull())
    return dated.groupBy("opened_on").agg(F.count(F.lit(1)).alias("n"))


def companies_preview(
    companies: DataFrame,
    ref_activity: DataFrame,
    ref_city: DataFrame,
    limit: int = 30_000,
    sector: str | None = None,
    city: str | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """First ``limit`` rows of the filtered listing by opening date (L3).

    The limit is the feature (a bounded preview); aggregates and exports work
    on the full filtered set.  Descriptions are resolved to codes first, so the
    filter and the top-k run on the companies table alone, and the lookups are
    joined to the ``limit`` rows that are left.  A histogram of opening dates
    (one row per distinct date) gives, as a scalar sub-query of the plan, the
    first date by which ``limit`` rows exist: later rows never reach the sort.  Without a
    sector or city the histogram may be given as ``days``, the stored
    :func:`opening_days` of the same Gold version, so that Gold is read once, up to that date.
    """
    base = companies.where(F.col("share_capital") > 0)
    for ref, column, value in (
        (ref_activity, "activity_code", _wild(sector, schemas.ANY_SECTOR)),
        (ref_city, "city_code", _wild(city, schemas.ANY_CITY)),
    ):
        if value is not None:
            codes = ref.where(F.col("description") == F.lit(value)).select(F.col("code").alias(column)).distinct()
            base = base.join(codes, column, "left_semi")
    filtered = _wild(sector, schemas.ANY_SECTOR) is not None or _wild(city, schemas.ANY_CITY) is not None
    per_day = opening_days(base) if days is None or filtered else days
    running = F.sum("n").over(Window.orderBy("opened_on").rowsBetween(Window.unboundedPreceding, 0))
    cutoff = per_day.select("opened_on", running.alias("_cum")).where(F.col("_cum") >= limit).agg(F.min("opened_on")).scalar()
    # With fewer dated rows than ``limit`` there is no such date, and every row may be shown.
    head = base.where(cutoff.isNull() | (F.col("opened_on") <= cutoff))
    order = [F.col(c).asc_nulls_last() for c in PREVIEW_ORDER]
    chosen = head.select(*PREVIEW_ORDER).orderBy(*order).limit(limit)
    return companies_labelled(chosen, ref_activity, ref_city, positive_capital=False).select(*LISTING_COLUMNS)


def capital_leaders(companies: DataFrame, most: int = 1000) -> DataFrame:
    """The side table of :func:`top_companies`: every company above a capital that at most ``most`` exceed.

    Of the ``most`` + 1 largest capitals the smallest is the edge; companies above it are
    kept, all of them, so a ranking as long as this table is exact whatever breaks its
    ties.  Companies at the edge are left out: there may be any number of them.
    """
    columns = ["legal_name", "share_capital", "activity_code"]
    first = companies.where(F.col("share_capital") > 0).select(*columns).orderBy(F.col("share_capital").desc()).limit(most + 1)
    edge = first.agg(F.when(F.count(F.lit(1)) > most, F.min("share_capital")).otherwise(F.lit(0).cast("decimal(20,2)"))).scalar()
    return first.where(F.col("share_capital") > edge)


def top_companies(
    companies: DataFrame, ref_activity: DataFrame, n: int = 25, leaders: DataFrame | None = None
) -> DataFrame:
    """Largest companies by capital with their sector (L1).

    With the stored :func:`capital_leaders` of the same Gold version only that table is
    read, if it has ``n`` rows; otherwise (many equal capitals at its edge) all companies are.
    """
    if leaders is not None and leaders.limit(n).count() >= n:
        companies = leaders
    a = ref_activity.select(F.col("code").alias("_a_code"), F.col("description").alias("sector"))
    pos = companies.where(F.col("share_capital") > 0)
    df = pos.join(a, pos.activity_code == a._a_code, "left").select(
        "legal_name", "share_capital", "sector"
    )
    order = _total_order([F.col("share_capital").desc_nulls_last()], ["legal_name", "sector"])
    return df.orderBy(*order).limit(n)


def top_companies_filtered(filtered: DataFrame, n: int = 25) -> DataFrame:
    """Largest companies of the filtered listing (L2); ``n`` in 10/25/50/100."""
    cols = ["legal_name", "share_capital", "opened_on", "sector", "city"]
    order = _total_order([F.col("share_capital").desc_nulls_last()], cols)
    return filtered.select(*cols).orderBy(*order).limit(n)


def headline_kpis(filtered: DataFrame) -> DataFrame:
    """Companies, total and mean capital of the whole filtered set."""
    return filtered.agg(
        F.count(F.lit(1)).alias("companies"),
        F.sum("share_capital").alias("total_capital"),
        mean_money(F.col("share_capital")).alias("mean_capital"),
    )


def openings_by_year(filtered: DataFrame) -> DataFrame:
    """Openings per year of the filtered set."""
    return filtered.groupBy(F.year("opened_on").alias("year")).agg(F.count(F.lit(1)).alias("companies"))


def capital_by_city_top(filtered: DataFrame, n: int = 10) -> DataFrame:
    """Cities with the largest summed capital in the filtered set.

    Rows without a city name are left out, as a group-by on the name would.
    """
    grouped = (
        filtered.where(F.col("city").isNotNull())
        .groupBy("city")
        .agg(F.sum("share_capital").alias("total_capital"))
    )
    return grouped.orderBy(F.col("total_capital").desc(), F.col("city")).limit(n)


def filter_options(ref_activity: DataFrame, ref_city: DataFrame) -> DataFrame:
    """Distinct sector and city descriptions for the filter widgets (Q1, Q2).

    ``kind`` tells the two lists apart; order each list with
    ``orderBy('kind', collate(description, 'UNICODE'))`` for accent-aware display.
    """
    sectors = ref_activity.select(F.lit("sector").alias("kind"), F.col("description")).distinct()
    cities = ref_city.select(F.lit("city").alias("kind"), F.col("description")).distinct()
    return sectors.unionByName(cities)


def ranked_options(options: DataFrame) -> DataFrame:
    """The option lists with each description's place in accent-aware order, from 1.

    Places come from ranges of the order (:mod:`firmscope.operators.ranges`), so no list is ordered in one task.
    """
    return ranges.dense_ranks(options, [F.collate(F.col("description"), "UNICODE")], "place", ["kind"])


def sorted_options(options: DataFrame) -> DataFrame:
    """The two option lists in accent-aware order."""
    return options.orderBy("kind", F.collate(F.col("description"), "UNICODE"))


# --- saved segments (X1) -----------------------------------------------------

SEGMENT_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("nome", T.StringType()),
            T.StructField("setor", T.StringType()),
            T.StructField("cidade", T.StringType()),
        ]
    )
)


def segments_from_json(
    spark: SparkSession, favourites_json: str | DataFrame, column: str = "favourites", owner: str | None = None
) -> DataFrame:
    """Saved filters ``[{"nome", "setor", "cidade"}]`` -> rows (owner, position, segment, seg_sector, seg_city).

    Accepts one JSON text or a DataFrame with a JSON text column (one list per
    user, named by the column ``owner``); the wildcard words become null.  A
    favourite is identified by its owner and its position in the owner's list:
    names may repeat.
    """
    if isinstance(favourites_json, str):
        json.loads(favourites_json)  # fail early on malformed input
        src = spark.createDataFrame([(favourites_json,)], f"{column} string")
    else:
        src = favourites_json
    who = F.col(owner) if owner else F.lit(None)
    items = src.select(
        who.cast("string").alias("owner"),
        F.posexplode(F.from_json(F.col(column), SEGMENT_SCHEMA)).alias("position", "s"),
    )
    return items.select(
        "owner",
        "position",
        F.col("s.nome").alias("segment"),
        F.when(F.col("s.setor") != schemas.ANY_SECTOR, F.col("s.setor")).alias("seg_sector"),
        F.when(F.col("s.cidade") != schemas.ANY_CITY, F.col("s.cidade")).alias("seg_city"),
    )


def segment_kpis(
    companies: DataFrame, ref_activity: DataFrame, ref_city: DataFrame, segments: DataFrame
) -> DataFrame:
    """KPIs (companies, total and mean capital) of every saved segment, one row per favourite.

    One scan: the table is reduced to (activity, city) code pairs, combined map-side,
    and labelled.  Each cell then counts in up to four wildcard patterns (sector and
    city, sector only, city only, everything); only what some segment asks for is
    added up, and one join hands the sums to the segments.
    """
    by_code = (
        companies.where(F.col("share_capital") > 0)
        .groupBy("activity_code", "city_code")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("share_capital").alias("cap"))
    )
    cells = companies_labelled(by_code, ref_activity, ref_city, positive_capital=False)
    # A cell of a pattern: whether the sector and the city are given, and their names ('' where not).
    given = [(by_sector, by_city) for by_sector in (True, False) for by_city in (True, False)]
    patterns = [
        F.struct(
            F.lit(by_sector).alias("by_sector"),
            F.lit(by_city).alias("by_city"),
            (F.col("sector") if by_sector else F.lit("")).alias("of_sector"),
            (F.col("city") if by_city else F.lit("")).alias("of_city"),
        )
        for by_sector, by_city in given
    ]
    keys = ["by_sector", "by_city", "of_sector", "of_city"]
    asked = segments.select(
        "*",
        F.col("seg_sector").isNotNull().alias("by_sector"),
        F.col("seg_city").isNotNull().alias("by_city"),
        F.coalesce("seg_sector", F.lit("")).alias("of_sector"),
        F.coalesce("seg_city", F.lit("")).alias("of_city"),
    )
    cells = cells.select(F.explode(F.array(*patterns)).alias("p"), "n", "cap").select("p.*", "n", "cap")
    sums = (
        cells.join(asked.select(*keys).distinct(), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.sum("n").alias("companies"), F.sum("cap").cast("decimal(28,2)").alias("total_capital"))
    )
    matched = asked.join(sums, keys, "left")
    return matched.select(
        "owner",
        "position",
        "segment",
        F.coalesce("companies", F.lit(0).cast("bigint")).alias("companies"),
        "total_capital",
        F.round(F.col("total_capital") / F.nullif(F.col("companies"), F.lit(0)), 2).alias("mean_capital"),
    )


def companies_filtered_sql(
    spark: SparkSession,
    companies: DataFrame,
    ref_activity: DataFrame,
    ref_city: DataFrame,
    sector: str | None = None,
    city: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The filtered listing as parametrised SQL.

    Values travel as named parameters (``:sector``, ``:city``, ``:n``), never as
    SQL text; the tables are passed as DataFrame arguments.  Same result as
    ``companies_filtered`` (with the preview's limit by opening date when ``limit`` is set).
    """
    sector = _wild(sector, schemas.ANY_SECTOR)
    city = _wild(city, schemas.ANY_CITY)
    sql = """
        SELECT e.company_id, e.legal_name, e.share_capital, e.opened_on,
               a.description AS sector, m.description AS city
        FROM {companies} e
        LEFT JOIN {ref_activity} a ON e.activity_code = a.code
        LEFT JOIN {ref_city} m ON e.city_code = m.code
        WHERE e.share_capital > 0
    """
    args: dict = {}
    if sector is not None:
        sql += " AND a.description = :sector"
        args["sector"] = sector
    if city is not None:
        sql += " AND m.description = :city"
        args["city"] = city
    if limit is not None:
        order = ", ".join(f"e.{c} ASC NULLS LAST" for c in PREVIEW_ORDER)
        sql += f" ORDER BY {order} LIMIT :n"
        args["n"] = int(limit)
    return spark.sql(sql, args=args, companies=companies, ref_activity=ref_activity, ref_city=ref_city)
