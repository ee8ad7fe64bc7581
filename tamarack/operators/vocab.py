"""Character vocabularies and label sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ManifestError

# Special symbols of the shared vocabulary and their ids.
SPECIAL = (("<pad>", 0), ("<unk>", 1), ("|", 2))


def characters(df: DataFrame, text: str) -> DataFrame:
    """Distinct characters; combined per partition before the shuffle."""
    return df.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("symbol")).where("symbol <> ''").distinct()


def _order() -> Column:
    """Code-point order, which the byte order of UTF-8 keeps."""
    return F.col("symbol").cast("binary")


def shared_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Ids of all characters but the blank after the special symbols, in code-point order.

    The number of distinct characters is bounded by Unicode, so ranking them in one task is fine.
    """
    known = [s for s, _ in SPECIAL]
    own = characters(df, text).where((F.col("symbol") != " ") & ~F.col("symbol").isin(*known))
    ranked = own.select("symbol", (F.row_number().over(Window.orderBy(_order())) + 2).cast("long").alias("id"))
    special = df.sparkSession.createDataFrame(list(SPECIAL), "symbol string, id long")
    return special.unionByName(ranked)


def require_characters(df: DataFrame, text: str) -> DataFrame:
    """The shared vocabulary; without any character of the text in it, an error."""
    found = shared_vocabulary(df, text)
    if found.where(F.col("id") > len(SPECIAL) - 1).isEmpty():
        raise ManifestError("the vocabulary would hold no character")
    return found


def plain_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """All characters with the blank as ``|`` from 0 in code-point order, then [UNK] and [PAD]."""
    own = characters(df, text).select(F.when(F.col("symbol") == " ", "|").otherwise(F.col("symbol")).alias("symbol")).distinct()
    ranked = own.select("symbol", (F.row_number().over(Window.orderBy(_order())) - 1).cast("long").alias("id"))
    size = own.agg(F.count(F.lit(1)).alias("n"))
    extra = size.select(F.explode(F.array(F.struct(F.lit("[UNK]").alias("symbol"), F.col("n").alias("id")), F.struct(F.lit("[PAD]").alias("symbol"), (F.col("n") + 1).alias("id"))))).select("col.symbol", "col.id")
    return ranked.unionByName(extra)


def unknown_characters(df: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """Characters of a text column that a vocabulary lacks, with their rows; the vocabulary is bounded by Unicode."""
    own = df.select(F.explode(F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), ""))).alias("symbol")).where("symbol NOT IN ('', ' ')")
    return own.join(F.broadcast(vocabulary.select("symbol")), "symbol", "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))


def label_ids(text: Column, head: list[int], tail: list[int], longest: int) -> Column:
    """Head ids, the code point of each character, tail ids; null if the text is empty or the labels too long."""
    body = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    ids = F.concat(F.array(*[F.lit(h).cast("long") for h in head]), body, F.array(*[F.lit(t).cast("long") for t in tail]))
    return F.when((F.length(text) > 0) & (F.size(ids) <= longest), ids)


def padded(ids: Column, width: Column, fill: int) -> Column:
    """Ids filled up to a common width."""
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("long"), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))
