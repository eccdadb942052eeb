"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated n times, n drawn from a Poisson distribution
whose mean is the source's target repetition rate

    rate(s) = weight(s) / sum of weights * total / (documents of s)

by inverting the distribution function at a number in [0, 1) hashed from the seed and
the document's id.  So a document's count doesn't depend on partitions, retries or
other documents.  Rates above ``STEP`` are cut into equal parts of at most ``STEP``, each
drawn with a hash of its own: sums of Poisson counts are Poisson.  The copies are
shuffled globally by a hash of seed, id and copy.

The distribution functions are tabulated once per source in plain SQL; documents are
joined with that table on the source.

Defined cases: a null source is a source of its own; sources without a weight get none
(no document of theirs is drawn); weights must not be negative, a null weight counts as
0; null ids are drawn like an id of their own; rows with equal ids get equal counts; texts
don't matter and may be null, empty or very long; an empty table gives an empty result;
all columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.llm.common import fresh, partitions, stored

#: The largest mean that is tabulated at once, and the entries that bring its distribution function to 1 in double precision.
STEP, ENTRIES = 8.0, 60


def uniform(seed: int, ident: Column, part: Column) -> Column:
    """A number in [0, 1): the first 52 bits of an MD5 hash of seed, part and id."""
    text = F.concat_ws(":", F.lit(str(seed)), part.cast("string"), F.coalesce(ident.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def temperature_weights(df: DataFrame, source_col: str = "source", exponent: float = 0.5) -> DataFrame:
    """Weights (source, weight) in proportion to a power of the sources' document counts."""
    counts = df.groupBy(df[source_col].alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(exponent)).alias("weight"))


def rates(df: DataFrame, weights: DataFrame, source_col: str = "source", epochs: float = 1.0) -> DataFrame:
    """Per source: its repetition rate, the number of parts it is cut into, the tabulated distribution of a part."""
    counts = df.groupBy(df[source_col].alias("source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.coalesce("weight", F.lit(0.0))
    weight = F.when(weight < 0, F.raise_error(F.lit("a negative weight")).cast("double")).otherwise(weight)
    given = weights.groupBy("source").agg(F.sum(weight).alias("weight"))
    sums = counts.agg(F.sum("n").alias("all_n")), given.agg(F.sum("weight").alias("all_weight"))
    rows = counts.join(given, counts["source"].eqNullSafe(given["source"]), "left").select(
        counts["source"], "n", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )
    all_n, all_weight = (s.first()[0] for s in sums)  # two numbers
    if not all_n or not all_weight:
        rate = F.lit(0.0)
    else:
        rate = F.col("weight") / F.lit(float(all_weight)) * F.lit(epochs * all_n) / F.col("n")
    rows = rows.select("source", rate.alias("rate")).withColumn(
        "parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")
    )
    mean = F.col("rate") / F.col("parts")
    first = F.array(F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf")))

    def follow(table: Column, k: Column) -> Column:
        last = F.element_at(table, -1)
        p = last["p"] * mean / k
        return F.concat(table, F.array(F.struct(p.alias("p"), (last["cdf"] + p).alias("cdf"))))

    table = F.aggregate(F.sequence(F.lit(1), F.lit(ENTRIES)), first, follow)
    return rows.withColumn("cdf", F.transform(table, lambda x: x["cdf"]))


def poisson_mix(
    df: DataFrame,
    weights: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    epochs: float = 1.0,
    seed: int = 17,
    keep_details: bool = False,
) -> DataFrame:
    """The drawn copies in shuffled order; ``epochs`` times as many rows as ``df`` on average.

    With ``keep_details`` the columns copy (from 1), copies and shuffle_key are added (with
    underscores behind them where ``df`` has a column of that name).
    """
    source, parts, cdf, copies, copy, key = (fresh(df, f"mix_{x}") for x in ("source", "parts", "cdf", "copies", "copy", "key"))
    by_source = stored(rates(df, weights, source_col, epochs), "rates").select(
        F.col("source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf)
    )
    ident = df[id_col]

    def drawn(total: Column, part: Column) -> Column:
        u = uniform(seed, F.col(id_col), part)
        return total + F.size(F.filter(F.col(cdf), lambda c: c <= u))

    counted = df.join(by_source, df[source_col].eqNullSafe(by_source[source])).withColumn(
        copies, F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), drawn)
    )
    exploded = counted.filter(F.col(copies) > 0).select(
        *df.columns, copies, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)
    )
    label = F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(ident.cast("string"), F.lit("null")), F.col(copy).cast("string"))
    exploded = exploded.withColumn(key, F.md5(label))
    mixed = exploded.repartition(partitions(df, epochs), key).sortWithinPartitions(key)
    if keep_details:
        return mixed.select(*df.columns, *[F.col(c).alias(fresh(df, name)) for c, name in ((copy, "copy"), (copies, "copies"), (key, "shuffle_key"))])
    return mixed.select(*df.columns)


#: As op3_mixing runs it: weights by the square roots of the sources' counts, one epoch, seed 17.
ORACLE_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(n)::DOUBLE AS all_n, sum(pow(n::DOUBLE, 0.5)) AS all_weight FROM counts),
rates AS (SELECT source, pow(n::DOUBLE, 0.5) / all_weight * all_n / n AS rate FROM counts, sums),
cut AS (SELECT source, greatest(1, ceil(rate / {STEP}))::INT AS parts, rate / greatest(1, ceil(rate / {STEP})) AS mean FROM rates),
tabulated AS (
  SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM cut
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM tabulated WHERE k < {ENTRIES}
),
tables AS (SELECT source, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdf FROM tabulated GROUP BY source),
counted AS (
  SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda part:
    len(list_filter(t.cdf, lambda c: c <= ('0x' || substr(md5('17:' || part || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(2**52)}))
  ))::INT AS copies
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, copies,
       md5('17:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted WHERE copies > 0)
"""
