"""Text exports of the point-of-sale warehouse: written, read and judged cell
by cell.

An export is a folder of header CSV files: UTF-8 with a byte-order mark,
quoted cells that may hold commas, quotes and line breaks, amounts with
thousands separators. Reading one gives all cells as text and, beside the good
rows, the raw record of rows that do not have the header's number of cells;
``parse`` types the cells and names every cell it had to reject.

A file with line breaks inside cells cannot be split between tasks, so
``write_export`` bounds the rows of a file and the files are what is read in
parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BOM = "\ufeff"
BAD_ROW = "_bad_row"
REJECTED = "rejected"


@dataclass(frozen=True)
class Cell:
    """How a text cell is read: ``text``, ``number`` (thousands separators
    removed), ``int`` or ``date`` (with ``fmt``). A blank cell is NULL, and
    rejected where it is ``required``."""
    kind: str
    fmt: str | None = None
    required: bool = False

    def value(self, c: Column) -> Column:
        plain = F.regexp_replace(c, ",", "")
        if self.kind == "number":
            return plain.try_cast("double")
        if self.kind == "int":
            return plain.try_cast("int")
        if self.kind == "date":
            return F.to_date(F.try_to_timestamp(c, F.lit(self.fmt)))
        return c

    @property
    def fault(self) -> str:
        return {"number": "not a number", "int": "not an integer", "date": "not a date"}.get(self.kind, "")


def write_export(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write text columns as an export. Every task writes its own files of at
    most ``rows_per_file`` rows."""
    first, *rest = df.columns
    cells = [F.col(f"`{first}`").alias(BOM + first), *(F.col(f"`{c}`") for c in rest)]
    (df.select(*cells).write.mode("overwrite").option("header", True).option("encoding", "UTF-8")
       .option("escape", '"').option("emptyValue", "").option("maxRecordsPerFile", rows_per_file).csv(path))


def read_export(spark: SparkSession, path: str, schema: StructType, *, header: bool = True,
                multi_line: bool = True) -> DataFrame:
    """All cells of an export as text, with the raw record in BAD_ROW where a
    row has too few or too many of them (its cells are then not to be
    trusted). With ``header`` the columns are found by name, whatever their
    order (a file whose header differs from the first one's is an error);
    without, ``schema`` gives their order. ``multi_line=False`` splits
    large files but ends a cell at a line break."""
    def reader():
        return (spark.read.option("header", header).option("encoding", "UTF-8").option("escape", '"')
                .option("multiLine", multi_line).option("mode", "PERMISSIVE"))
    names = list(schema.names)
    if header:
        names = reader().csv(path).columns
    place = {h.strip(BOM + " ").strip(): h for h in reversed(names)}
    missing = [c for c in schema.names if c not in place]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header {names}")
    text = StructType([*(StructField(h, StringType()) for h in names), StructField(BAD_ROW, StringType())])
    df = reader().schema(text).option("enforceSchema", False).option("columnNameOfCorruptRecord", BAD_ROW).csv(path)
    return df.select(*(F.col(f"`{place[c]}`").alias(c) for c in schema.names), BAD_ROW)


def parse(df: DataFrame, cells: dict[str, Cell]) -> DataFrame:
    """The typed columns of ``cells`` and REJECTED: an array of (column,
    reason, cell) with one entry per rejected cell, or one for a row of the
    wrong width (column NULL, the raw record as cell). Rejected cells are NULL,
    and so are all cells of such a row."""
    bad = F.col(BAD_ROW).isNotNull()
    kind = "struct<column: string, reason: string, cell: string>"
    values, faults = [], []
    for name, cell in cells.items():
        c = F.col(f"`{name}`")
        blank = F.coalesce(F.trim(c) == "", F.lit(True))
        value = cell.value(c)
        values.append(F.when(~bad & ~blank, value).alias(name))
        fault = F.when(blank, F.lit("missing") if cell.required else F.lit(None))
        if cell.fault:
            fault = fault.when(value.isNull(), F.lit(cell.fault))
        faults.append(F.when(fault.isNotNull(), F.struct(F.lit(name).alias("column"), fault.alias("reason"), c.alias("cell")).cast(kind)))
    row = F.struct(F.lit(None).alias("column"), F.lit("row width").alias("reason"), F.col(BAD_ROW).alias("cell")).cast(kind)
    return df.select(*values, F.when(bad, F.array(row)).otherwise(F.array_compact(F.array(*faults))).alias(REJECTED))


def good_rows(parsed: DataFrame) -> DataFrame:
    """Rows of the right width; their rejected cells are NULL."""
    wide = F.coalesce(F.get(F.col(REJECTED), F.lit(0))["reason"] != "row width", F.lit(True))
    return parsed.where(wide).drop(REJECTED)


def rejects(parsed: DataFrame) -> DataFrame:
    """(column, reason, n_cells, sample): rejected cells by column and reason,
    with the smallest one as a sample."""
    return (parsed.select(F.inline(REJECTED)).groupBy("column", "reason")
            .agg(F.count(F.lit(1)).alias("n_cells"), F.min("cell").alias("sample")))
