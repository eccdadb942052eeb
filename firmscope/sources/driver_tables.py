"""Registry-shaped inputs built from the driver's test tables.

The test tables are a TPC-H-like star schema, not registry data.  This module
maps them onto the registry model so that every operator runs on them at each
scale factor, and keeps the equivalent SQL next to each Spark form so the
DuckDB oracle sees exactly the same input.

``companies`` (the Gold-shaped table): one row per line item.

    company_id        l_orderkey as text, zero-padded to 8 (repeats)
    legal_name        c_name
    legal_nature_code c_nationkey           lookup: nation
    share_capital     c_acctbal as decimal(20,2)
    opened_on         o_orderdate as date, 0, 7, 14 or 21 years earlier by o_orderkey mod 4; none for 1 order in 67
    activity_code     l_partkey             lookup: part without keys divisible by 10; none for 1 order in 79
    city_code         l_suppkey             lookup: supplier without keys divisible by 25; none for 1 order in 89
    state             n_name of the supplier's nation, of the customer's for line 7 (so cities lie in
                      several states); none for 1 order in 83
    status_code       l_returnflag R -> 8 (closed), N -> 2 (active), A -> 4
    status_on         l_shipdate as date, as many years earlier; none for 1 order in 73, before opened_on for 1 in 71

The Bronze-shaped text frames (``companies_raw``, ``establishments_raw``) feed
the load pipeline, with defects injected into the opening date.

The few ``key % n`` expressions here shape properties of the inputs (a lookup
with missing codes, rows with defective dates, shard ids); they never select
a subset of the rows to process: every query runs over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmscope import schemas
from firmscope.plans import store

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Parameters that make the test tables behave like the registry.
AS_OF = "2002-01-01"
SURVIVAL_MIN_COUNT = 150
ACTIVITY_PAD = 4
# Bumped whenever the shape or layout of a derived table changes, so stored
# versions built by older code are not reused.
DATA_VERSION = 5
#: Bytes of stored input that one task of a join of the large tables is meant to sort.
PART_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return store.read_input(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def input_paths(sf_dir: str, names: list[str]) -> list[str]:
    return [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names]


def input_bytes(spark: SparkSession, sf_dir: str, names: list[str]) -> int:
    """Bytes of the tables' files."""
    return sum(size for p in input_paths(sf_dir, names) for _, size, _ in store.fs(spark, p).files(p))


def _dealt(df: DataFrame, key: str, sf_dir: str, names: list[str]) -> DataFrame:
    """One side of a join on ``key``, dealt over a task for each PART_BYTES of the joined tables.

    Where the session has partitions enough, the planner deals the rows out.
    """
    n = -(-input_bytes(df.sparkSession, sf_dir, names) // PART_BYTES)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _status_from_flag(flag: Column) -> Column:
    return (
        F.when(flag == "R", F.lit(schemas.STATUS_CLOSED))
        .when(flag == "N", F.lit(schemas.STATUS_ACTIVE))
        .when(flag == "A", F.lit(4))
    )


def companies_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy plan of the Gold-shaped table (see module docstring)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal"
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # orders ⋈ customer first: the narrower side is shuffled twice, line items
    # once.  Both fact tables grow with the data, so their join is a shuffled
    # sort-merge join by design (never a broadcast, whatever the test size);
    # dimension sides are left to the size-checked planner.
    own = nation.select(F.col("n_nationkey").alias("_nation"), F.col("n_name").alias("_customer_nation"))
    customer = customer.join(own, customer.c_nationkey == own._nation, "left")
    of_customers = ["orders", "customer"]
    orders, customer = _dealt(orders, "o_custkey", sf_dir, of_customers), _dealt(customer, "c_custkey", sf_dir, of_customers)
    order_side = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    supplier_side = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
    facts = ["lineitem", "orders", "customer"]
    li = _dealt(li, "l_orderkey", sf_dir, facts)
    order_side = _dealt(order_side, "o_orderkey", sf_dir, facts)
    joined = li.join(
        order_side.hint("merge"), li.l_orderkey == order_side.o_orderkey, "inner"
    ).join(supplier_side, li.l_suppkey == supplier_side.s_suppkey, "left")
    key = F.col("l_orderkey")

    def none_each(n: int, value: Column) -> Column:
        return F.when(key % n != 0, value)

    back = (key % 4).cast("int") * -84  # months
    opened = F.add_months(F.col("o_orderdate").cast("date"), back)
    return joined.select(
        F.lpad(F.col("l_orderkey").cast("string"), 8, "0").alias("company_id"),
        F.col("c_name").alias("legal_name"),
        F.col("c_nationkey").cast("bigint").alias("legal_nature_code"),
        F.coalesce(F.col("c_acctbal").cast(schemas.MONEY), F.lit(0).cast(schemas.MONEY)).alias(
            "share_capital"
        ),
        none_each(67, opened).alias("opened_on"),
        none_each(79, F.col("l_partkey")).alias("activity_code"),
        none_each(89, F.col("l_suppkey")).alias("city_code"),
        none_each(83, F.when(F.col("l_linenumber") == 7, F.col("_customer_nation")).otherwise(F.col("n_name"))).alias("state"),
        _status_from_flag(F.col("l_returnflag")).alias("status_code"),
        none_each(
            73,
            F.when(key % 71 == 0, F.date_sub(opened, 10)).otherwise(F.add_months(F.col("l_shipdate").cast("date"), back)),
        ).alias("status_on"),
    )


def _gold_layout(df: DataFrame) -> DataFrame:
    from firmscope.operators.gold import gold_layout

    return gold_layout(df)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gold-shaped table, written once per input version and read back."""
    names = ["lineitem", "orders", "customer", "supplier", "nation"]
    key = store.fingerprint(spark, input_paths(sf_dir, names), {"v": DATA_VERSION})
    return store.materialise(spark, "companies", key, lambda: companies_frame(spark, sf_dir), _gold_layout)


def ref_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity lookup: part names, with every tenth code missing (unmapped)."""
    return (
        table(spark, sf_dir, "part")
        .where(F.col("p_partkey") % 10 != 0)
        .select(F.col("p_partkey").alias("code"), F.col("p_name").alias("description"))
    )


def ref_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City lookup: supplier names, with every 25th code missing (unmapped)."""
    return table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 25 != 0).select(
        F.col("s_suppkey").alias("code"), F.col("s_name").alias("description")
    )


def ref_legal_nature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("code"), F.col("n_name").alias("description")
    )


# --- Bronze-shaped text frames ---------------------------------------------


def _compact(d: Column) -> Column:
    return F.date_format(d.cast("date"), "yyyyMMdd")


def companies_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw companies file: one row per order, all text, decimal-comma capital;
    the capital is no number for 1 order in 61 and missing for 1 in 59."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal"
    )
    of_customers = ["orders", "customer"]
    orders, customer = _dealt(orders, "o_custkey", sf_dir, of_customers), _dealt(customer, "c_custkey", sf_dir, of_customers)
    j = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    none = F.lit(None).cast("string")
    return j.select(
        F.col("o_orderkey").cast("string").alias("cnpj_basico"),
        F.col("c_name").alias("razao_social"),
        F.col("c_nationkey").cast("string").alias("natureza_juridica"),
        none.alias("qualificacao_responsavel"),
        F.when(F.col("o_orderkey") % 61 == 0, F.lit("n/d"))
        .when(F.col("o_orderkey") % 59 != 0, F.replace(F.col("c_acctbal").cast(schemas.MONEY).cast("string"), F.lit("."), F.lit(",")))
        .alias("capital_social"),
        none.alias("porte_empresa"),
        none.alias("ente_federativo_responsavel"),
    )


def establishments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw establishments file: one row per line item, all text.

    Head office is line number 1.  Opening-date defects by order key mod 50:
    0 -> '0', 1 -> '20210231' (impossible), 2 -> null, 3 -> '20990101' (future).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier_side = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left")
    # Fact-to-fact join: shuffled sort-merge, as in ``companies_frame``.
    facts = ["lineitem", "orders"]
    li, orders = _dealt(li, "l_orderkey", sf_dir, facts), _dealt(orders, "o_orderkey", sf_dir, facts)
    j = li.join(orders.hint("merge"), li.l_orderkey == orders.o_orderkey, "inner").join(
        supplier_side, li.l_suppkey == supplier_side.s_suppkey, "left"
    )
    m = F.col("l_orderkey") % 50
    opened = (
        F.when(m == 0, F.lit("0"))
        .when(m == 1, F.lit("20210231"))
        .when(m == 2, F.lit(None).cast("string"))
        .when(m == 3, F.lit("20990101"))
        .otherwise(_compact(F.col("o_orderdate")))
    )
    cols = {c: F.lit(None).cast("string") for c in schemas.ESTABLISHMENTS_RAW_COLUMNS}
    cols.update(
        cnpj_basico=F.col("l_orderkey").cast("string"),
        matriz_filial=F.col("l_linenumber").cast("string"),
        situacao_cadastral=_status_from_flag(F.col("l_returnflag")).cast("string"),
        data_situacao=_compact(F.col("l_shipdate")),
        data_inicio_atividade=opened,
        cnae_fiscal=F.col("l_partkey").cast("string"),
        uf=F.col("n_name"),
        municipio=F.col("l_suppkey").cast("string"),
    )
    return j.select(*[cols[c].alias(c) for c in schemas.ESTABLISHMENTS_RAW_COLUMNS])


# --- The same inputs as SQL (DuckDB dialect) for the oracle ------------------

SQL_CTES: list[tuple[str, str]] = [
    (
        "companies",
        """
        SELECT lpad(CAST(l.l_orderkey AS VARCHAR), 8, '0') AS company_id,
               c.c_name AS legal_name,
               CAST(c.c_nationkey AS BIGINT) AS legal_nature_code,
               COALESCE(CAST(c.c_acctbal AS DECIMAL(20,2)), 0) AS share_capital,
               CASE WHEN l.l_orderkey % 67 <> 0 THEN CAST(CAST(o.o_orderdate AS DATE) - to_months((84 * (l.l_orderkey % 4))::INT) AS DATE)
                    END AS opened_on,
               CASE WHEN l.l_orderkey % 79 <> 0 THEN l.l_partkey END AS activity_code,
               CASE WHEN l.l_orderkey % 89 <> 0 THEN l.l_suppkey END AS city_code,
               CASE WHEN l.l_orderkey % 83 = 0 THEN NULL WHEN l.l_linenumber = 7 THEN cn.n_name ELSE n.n_name END AS state,
               CASE l.l_returnflag WHEN 'R' THEN 8 WHEN 'N' THEN 2 WHEN 'A' THEN 4 END AS status_code,
               CASE WHEN l.l_orderkey % 73 = 0 THEN NULL
                    WHEN l.l_orderkey % 71 = 0
                         THEN CAST(CAST(o.o_orderdate AS DATE) - to_months((84 * (l.l_orderkey % 4))::INT) AS DATE) - 10
                    ELSE CAST(CAST(l.l_shipdate AS DATE) - to_months((84 * (l.l_orderkey % 4))::INT) AS DATE) END AS status_on
        FROM lineitem l
        JOIN orders o ON o.o_orderkey = l.l_orderkey
        LEFT JOIN customer c ON c.c_custkey = o.o_custkey
        LEFT JOIN nation cn ON cn.n_nationkey = c.c_nationkey
        LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
        LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
        """,
    ),
    ("ref_activity", "SELECT p_partkey AS code, p_name AS description FROM part WHERE p_partkey % 10 <> 0"),
    ("ref_city", "SELECT s_suppkey AS code, s_name AS description FROM supplier WHERE s_suppkey % 25 <> 0"),
    ("ref_legal_nature", "SELECT CAST(n_nationkey AS BIGINT) AS code, n_name AS description FROM nation"),
    (
        "companies_raw",
        """
        SELECT CAST(o.o_orderkey AS VARCHAR) AS cnpj_basico,
               c.c_name AS razao_social,
               CAST(c.c_nationkey AS VARCHAR) AS natureza_juridica,
               CASE WHEN o.o_orderkey % 61 = 0 THEN 'n/d'
                    WHEN o.o_orderkey % 59 <> 0 THEN replace(CAST(CAST(c.c_acctbal AS DECIMAL(20,2)) AS VARCHAR), '.', ',')
                    END AS capital_social
        FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
        """,
    ),
    (
        "establishments_raw",
        """
        SELECT CAST(l.l_orderkey AS VARCHAR) AS cnpj_basico,
               CAST(l.l_linenumber AS VARCHAR) AS matriz_filial,
               CAST(CASE l.l_returnflag WHEN 'R' THEN 8 WHEN 'N' THEN 2 WHEN 'A' THEN 4 END AS VARCHAR)
                   AS situacao_cadastral,
               strftime(CAST(l.l_shipdate AS DATE), '%Y%m%d') AS data_situacao,
               CASE l.l_orderkey % 50 WHEN 0 THEN '0' WHEN 1 THEN '20210231' WHEN 2 THEN NULL
                    WHEN 3 THEN '20990101' ELSE strftime(CAST(o.o_orderdate AS DATE), '%Y%m%d') END
                   AS data_inicio_atividade,
               CAST(l.l_partkey AS VARCHAR) AS cnae_fiscal,
               n.n_name AS uf,
               CAST(l.l_suppkey AS VARCHAR) AS municipio
        FROM lineitem l
        JOIN orders o ON o.o_orderkey = l.l_orderkey
        LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey
        LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
        """,
    ),
]
