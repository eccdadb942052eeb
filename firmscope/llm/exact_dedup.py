"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each hash group.

Texts are equal when identical after deleting every character of
``[\\x20\\x09-\\x0D]``.  Rows are grouped by the 128-bit hash *and* the normalised
text, so two texts that share a hash stay apart.  The aggregation is combined
before the shuffle: of a hot group each task passes on one row.

Defined cases: a null text counts as empty, empty texts are equal to each other;
a null id sorts after every other id; of rows that agree in text length and id
(repeated rows) exactly one is kept; an empty table gives an empty result; extra
columns are ignored by :func:`exact_groups` and carried by :func:`deduplicate`,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmscope.llm.common import SPACES, stored


def content_hash(text: Column) -> Column:
    """128-bit hash of the normalised text."""
    return F.md5(text)


def _prepared(df: DataFrame, id_col: str, text_col: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    raw = F.coalesce(df[text_col], F.lit(""))
    rows = df.select(
        df[id_col].alias("id"), F.length(raw).alias("n"), F.translate(raw, SPACES, "").alias("norm")
    )
    return rows.withColumn("h", hash_of(F.col("norm")))


def _best(n: Column, ident: Column) -> Column:
    """Orders the rows of a group: most code points first, then the smallest id, null ids last."""
    return F.struct((-n).alias("neg"), ident.isNull().alias("missing"), ident.alias("id"))


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and the SHA-256 of the normalised text."""
    rows = _prepared(df, id_col, text_col, hash_of)

    def by_text(part: DataFrame) -> DataFrame:
        return part.groupBy("h", "norm").agg(
            F.min(_best(F.col("n"), F.col("id"))).alias("best"), F.count(F.lit(1)).alias("size")
        )

    per_hash = stored(
        by_text(rows)
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("best").alias("best"), F.sum("size").alias("size")),
        "exact-groups",
    )
    # Rows that agree in everything are counted and unfolded again, so one of them can be told from the rest.
    narrow = rows.select("id", "n", "h", F.sha2("norm", 256).alias("sha"))
    narrow = narrow.groupBy("id", "n", "h", "sha").agg(F.count(F.lit(1)).alias("copies"))
    found = narrow.join(per_hash.filter("texts = 1").select("h", "best", "size"), "h")
    clashing = per_hash.filter("texts > 1").select("h")
    if not clashing.isEmpty():  # different texts under one hash: the text itself joins the key
        apart = rows.join(clashing, "h", "left_semi")
        copies = apart.groupBy("id", "n", "h", "norm").agg(F.count(F.lit(1)).alias("copies"))
        apart = copies.join(by_text(apart), ["h", "norm"]).withColumn("sha", F.sha2("norm", 256))
        found = found.unionByName(apart.select(found.columns))
    found = found.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    is_best = (F.col("id").eqNullSafe(F.col("best.id"))) & (F.col("best.neg") == -F.col("n")) & (F.col("copy") == 1)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        is_best.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """The rows that stay, with all their columns: one per group of equal texts."""
    raw = F.coalesce(df[text_col], F.lit(""))
    norm = F.translate(raw, SPACES, "")
    rows = df.select(
        hash_of(norm).alias("h"),
        norm.alias("norm"),
        _best(F.length(raw), df[id_col]).alias("rank"),
        F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"),
    )
    kept = rows.groupBy("h", "norm").agg(F.min_by("row", "rank").alias("row"))
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
"""
