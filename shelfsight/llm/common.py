"""Small shared helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.plans.execution import owned_tables, table_path

# Characters that separate words everywhere in this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def text_column(name: str = "text") -> Column:
    """The text with NULL read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text as bytes) for Arrow operators; other columns are left
    out here, so their names cannot clash with working columns."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it
    back: the lineage is cut and a lost executor re-reads the table. The table
    belongs to the enclosing ``settled`` or ``owned_tables``, if any."""
    spark = df.sparkSession
    path = table_path(spark)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], compression: str = "zstd") -> DataFrame:
    """The result of ``build()`` as a written table. All tables that it wrote
    on the way are deleted, also after an error."""
    path = table_path(spark)
    with owned_tables(spark):
        df = build()
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FILTER_BITS = 1 << 26


def with_ids_among(rows: DataFrame, ids: DataFrame, key: str, out: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a flag ``out`` that is true for all rows whose ``key`` is
    in ``ids`` and, by chance, for a few others: a bitmap of ``bits`` bits (8
    MB, whatever the number of ids) is broadcast, so the rows are not
    shuffled. More bits let fewer others through."""
    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))
    span = 8 * 4096
    at = place(F.col(key))
    bitmap = (ids.select(at.alias("p")).groupBy(F.expr(f"p div {span}").alias("_piece"))
              .agg(F.bitmap_construct_agg(F.col("p") % span).alias("_bits")))
    rows = rows.withColumn("_p", at).withColumn("_piece", F.expr(f"_p div {span}")).join(F.broadcast(bitmap), "_piece", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.expr(f"(_p % {span}) div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(_p % 8 AS int)) & 1 = 1")
    return rows.withColumn("_byte", byte).withColumn(out, F.coalesce(bit, F.lit(False))).drop("_p", "_piece", "_bits", "_byte")
