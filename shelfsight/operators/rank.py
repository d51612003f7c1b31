"""Week-over-week assortment flags over weekly ranked (SKU, Store) sales.

W2 is the latest week in the data, W1 the week before it (week keys
``yyyyWww`` sort chronologically). Flags, per row:

* ``range_expansion``  True on the W2 row of a pair that has no W1 row; NULL otherwise
* ``in_W1_not_W2``     True on the W1 row (with non-zero sales) of a pair that has
                       no W2 row; NULL otherwise
* ``material_change``  s = the pair's W1 sales (0 when absent), a = the W2 average
                       sales of the (SKU, concept) (0 when absent):
                       NULL when s = 0; True when s > a and the row is
                       ``in_W1_not_W2``; False otherwise
* ``unaddressed_gap``  neither of the first two flags (NULL counts as not set)
                       and the row's sales are 0
* ``newcomer``         the pair is in the top 50 (rank 1..50) in W2 and not in W1;
                       set on every row of the pair, False otherwise

Plan shape: the two period keys come from one scalar subquery; all
pair-level facts come from one grouped aggregate over the rows of W1 and W2
(partial aggregation; one row per pair), the concept average from a second
small aggregate over W2; both are joined back once. Every join key is
unique on the aggregate side, so no join fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from shelfsight.functions.columns import as_double
from shelfsight.plans.copartition import sliced
from shelfsight.plans.execution import materialize
from shelfsight.sources.schemas import RANK_WEEKLY_RENAME

COLUMNS = ["Index", "Date", "Company", "BusinessUnit", "Concept_NEW", "Category",
           "Store", "SKU", "NetSales", "rank"]
TOP_N = 50
# Rows of a slice of the ranked table, and the most row hashes that are looked
# up rather than exchanging all rows.
SLICE_ROWS = 250_000
REPEATED = 1_000_000


def _c(n: str) -> Column:
    return F.col(n)


def clean_rank(raw: DataFrame) -> DataFrame:
    """Select and rename the ten report columns; sales and rank as DOUBLE
    with NULL -> 0 (text cells that do not parse become NULL first)."""
    ren = {k: v for k, v in RANK_WEEKLY_RENAME.items() if k in raw.columns}
    df = raw.withColumnsRenamed(ren) if ren else raw
    return df.select(
        *[c for c in COLUMNS if c not in ("NetSales", "rank")],
        F.coalesce(as_double(df, "NetSales"), F.lit(0.0)).alias("NetSales"),
        F.coalesce(as_double(df, "rank"), F.lit(0.0)).alias("rank"),
    ).select(*COLUMNS)


def rank_desc(df: DataFrame, group: list[str], value: str, out: str,
              partitions: int | None = None) -> DataFrame:
    """Exact ``rank()`` of ``value`` (descending, NULLs last) within each
    ``group``, without putting a group, or the rows of one value, into one
    task: see ``value_slices`` and ``rank_slices``."""
    return rank_slices(value_slices(df, group, value, partitions), group, value, out).drop("_slice")


def value_slices(df: DataFrame, group: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned once on (group, value, row hash) and written
    with its slice number in ``_slice``. Slices grow in number with the rows,
    not in size."""
    order = [*[_c(g).asc() for g in group], _c(value).desc_nulls_last(), F.xxhash64(*df.columns)]
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sliced(df, order, "_slice", partitions or max(least, -(-df.count() // SLICE_ROWS)))


def rank_slices(rows: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """``rows`` of ``value_slices`` with the rank within ``group``, which
    holds the group of the slices and maybe more columns.

    A window ranks inside (group, slice) without another exchange; one row per
    (group, slice) carries the rows of the group's earlier slices. Only a value
    that goes on from one slice to the next needs more: it has the rank of the
    first slice that holds it."""
    part = [*group, "_slice"]

    def same(names: list[str], tag: str) -> list[Column]:
        return [_c(n).eqNullSafe(_c(f"{tag}{i}")) for i, n in enumerate(names)]

    def tagged(names: list[str], tag: str) -> list[Column]:
        return [_c(n).alias(f"{tag}{i}") for i, n in enumerate(names)]
    # per slice: its rows, its first and its last value
    ends = rows.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"), F.max(value).alias("_first"), F.min(value).alias("_last"), F.count(value).alias("_set"))
    ends = ends.withColumn("_last", F.when(_c("_set") == _c("_n"), _c("_last")))
    ordered = Window.partitionBy(*group).orderBy("_slice")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    following = F.lead(F.struct("_first")).over(ordered)
    ends = materialize(ends.select(
        *part, "_n", "_first", "_last", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        (following.isNotNull() & _c("_last").eqNullSafe(following["_first"])).alias("_goes_on")))

    # where the values that go on begin
    open_ends = materialize(ends.where("_goes_on").select(*tagged(part, "_o"), _c("_last").alias("_v"), (_c("_off") + _c("_n")).alias("_to")))
    held = rows.join(open_ends, [*same(part, "_o"), _c(value).eqNullSafe(_c("_v"))])
    held = held.groupBy(*part, "_v", "_to").agg(F.count(F.lit(1)).alias("_held"))
    begin = held.groupBy(*group, "_v").agg(F.min(_c("_to") - _c("_held")).alias("_begin")).select(*tagged(group, "_b"), "_v", "_begin")
    ends = ends.join(begin, [*same(group, "_b"), _c("_first").eqNullSafe(_c("_v"))], "left")
    # written, so that Spark knows how small it is: the rows are not exchanged
    ends = materialize(ends.select(*tagged(part, "_e"), "_first", "_off", F.coalesce("_begin", "_off").alias("_begin")))
    inside = rows.withColumn("_in", F.rank().over(Window.partitionBy(*part).orderBy(_c(value).desc_nulls_last())))
    rank = F.when(_c(value).eqNullSafe(_c("_first")), _c("_begin") + 1).otherwise(_c("_off") + _c("_in"))
    return inside.join(ends, same(part, "_e")).select(*rows.columns, rank.cast("int").alias(out))


def top_k(df: DataFrame, group: list[str], value: str, k: int, out: str = "rank") -> DataFrame:
    """Rows of the ``k`` highest ranks of ``value`` in each group, ties
    included. Every task first keeps the top of the groups it holds (the
    optimizer's group limit), so no more than ``k`` rows (and ties) of a group
    leave a task, and no group is sorted as a whole."""
    order = Window.partitionBy(*group).orderBy(_c(value).desc_nulls_last())
    return df.withColumn(out, F.rank().over(order)).where(_c(out) <= k)


def top_lists(weekly: DataFrame, n: int = TOP_N) -> DataFrame:
    """The top-n lists of W1 and W2 straight from the weekly sales, ranking
    nothing else."""
    w1, w2 = last_two_weeks(weekly)
    two = weekly.where(_c("Date").isin(w1, w2)).withColumn("NetSales", F.coalesce("NetSales", F.lit(0.0)))
    return top_k(two, ["Date"], "NetSales", n).select(
        "SKU", "Store", "Date", "NetSales", _c("rank").cast("double").alias("rank"))


def preview(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first ``n`` rows in ``order``: each task keeps its first n."""
    return df.orderBy(*order).limit(n)


def add_ranks(df: DataFrame, store_rank: bool = True) -> DataFrame:
    """Overall rank of each row within its week by sales (ties share a rank),
    and optionally the rank within (week, store)."""
    # slices of (week, sales) are in order of sales for each store of the week too
    out = rank_slices(value_slices(df, ["Date"], "NetSales"), ["Date"], "NetSales", "rank")
    if store_rank:
        out = rank_slices(out, ["Date", "Store"], "NetSales", "store_rank")
    return out.drop("_slice")


def last_two_weeks(df: DataFrame) -> tuple[Column, Column]:
    """(W1, W2): the week before the latest, and the latest week.

    The two weeks (distinct weeks, the top two kept per task and then overall,
    so no task gathers all keys) are written once; a scalar subquery over them
    returns both keys."""
    top = materialize(df.select("Date").distinct().orderBy(F.col("Date").desc()).limit(2))
    weeks = top.agg(F.sort_array(F.collect_list("Date"), asc=False)).scalar()
    return F.get(weeks, 1), F.get(weeks, 0)


def _in_top(rank: Column, n: int = TOP_N) -> Column:
    # A rank of 0 stands for "no rank" after cleaning: never top-n.
    return rank.between(1, n)


def pair_weeks(df: DataFrame, w1: Column, w2: Column) -> DataFrame:
    """One row per (SKU, Store) seen in W1 or W2 with presence, W1 sales
    and top-n membership per week."""
    two = df.where(_c("Date").isin(w1, w2))
    is1, is2 = _c("Date") == w1, _c("Date") == w2
    return (two.groupBy("SKU", "Store")
               .agg(F.max(is1).alias("_in_w1"),
                    F.max(is2).alias("_in_w2"),
                    F.sum(F.when(is1, _c("NetSales"))).alias("_sales_w1"),
                    F.max(is1 & _in_top(_c("rank"))).alias("_top_w1"),
                    F.max(is2 & _in_top(_c("rank"))).alias("_top_w2")))


def concept_average(df: DataFrame, w2: Column) -> DataFrame:
    """Average W2 sales per (SKU, concept) over stores."""
    return (df.where(_c("Date") == w2)
              .groupBy("SKU", "Concept_NEW")
              .agg(F.avg("NetSales").alias("avgSales_lastWeek")))


def assortment_flags(df: DataFrame, keep_helpers: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """All five flags in one pass (plus, with ``keep_helpers``, the two
    sales figures behind ``material_change`` and ``in_W1_not_W2``). With
    ``rows`` (of ``df``) only those are flagged."""
    w1, w2 = last_two_weeks(df)
    # written, so that Spark knows how small they are: the rows of the other
    # weeks are not exchanged to meet them
    pairs = materialize(pair_weeks(df, w1, w2))
    concept = materialize(concept_average(df, w2))
    j = ((df if rows is None else rows).join(pairs, ["SKU", "Store"], "left")
           .join(concept, ["SKU", "Concept_NEW"], "left"))
    # the period keys enter as columns, once
    j = j.withColumn("_w1", w1).withColumn("_w2", w2)
    date = _c("Date")
    in_w1 = F.coalesce(_c("_in_w1"), F.lit(False))
    in_w2 = F.coalesce(_c("_in_w2"), F.lit(False))
    range_expansion = F.when((date == _c("_w2")) & ~in_w1, F.lit(True))
    lost = F.when((date == _c("_w1")) & ~in_w2 & (_c("NetSales") != 0), F.lit(True))
    s = F.coalesce(_c("_sales_w1"), F.lit(0.0))
    a = F.coalesce(_c("avgSales_lastWeek"), F.lit(0.0))
    j = (j.withColumn("range_expansion", range_expansion)
          .withColumn("in_W1_not_W2", lost)
          .withColumn("sumSales_oldWeek", s)
          .withColumn("avgSales_lastWeek", a))
    material = (F.when(s == 0, F.lit(None).cast("boolean"))
                 .when((s > a) & F.coalesce(_c("in_W1_not_W2"), F.lit(False)), F.lit(True))
                 .otherwise(F.lit(False)))
    gap = (~F.coalesce(_c("range_expansion"), F.lit(False))
           & ~F.coalesce(_c("in_W1_not_W2"), F.lit(False))
           & (_c("NetSales") == 0))
    newcomer = F.coalesce(_c("_top_w2") & ~F.coalesce(_c("_top_w1"), F.lit(False)), F.lit(False))
    j = (j.withColumn("material_change", material)
          .withColumn("unaddressed_gap", gap)
          .withColumn("newcomer", newcomer))
    extra = ["range_expansion", "in_W1_not_W2", "material_change", "unaddressed_gap", "newcomer"]
    if keep_helpers:
        extra += ["sumSales_oldWeek", "avgSales_lastWeek"]
    return j.select(*[c for c in df.columns], *extra)


def range_expansion(df: DataFrame) -> DataFrame:
    return assortment_flags(df).select(*df.columns, "range_expansion")


def in_w1_not_w2(df: DataFrame) -> DataFrame:
    return assortment_flags(df).select(*df.columns, "in_W1_not_W2")


def material_change(df: DataFrame) -> DataFrame:
    return assortment_flags(df, keep_helpers=True).select(
        *df.columns, "in_W1_not_W2", "sumSales_oldWeek", "avgSales_lastWeek", "material_change")


def unaddressed_gap(df: DataFrame) -> DataFrame:
    return assortment_flags(df).select(
        *df.columns, "range_expansion", "in_W1_not_W2", "unaddressed_gap")


def newcomer(df: DataFrame) -> DataFrame:
    return assortment_flags(df).select(*df.columns, "newcomer")


def top_n(df: DataFrame, n: int = TOP_N) -> DataFrame:
    """Rows of W1 and W2 ranked 1..n (the two weekly top-n lists)."""
    w1, w2 = last_two_weeks(df)
    return (df.where(_c("Date").isin(w1, w2) & _in_top(_c("rank"), n))
              .select("SKU", "Store", "Date", "NetSales", "rank"))


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Data-quality check: (SKU, Store, week) keys with more than one row,
    and how many. The flags expect these keys to be unique; with duplicates
    the pair aggregates sum the week's rows instead of multiplying rows."""
    return (df.groupBy("SKU", "Store", "Date").agg(F.count(F.lit(1)).alias("n_rows"))
              .where(_c("n_rows") > 1))


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df`` without repeated rows. Row hashes are exchanged, and whole rows
    only where a hash comes more than once."""
    def plain(f) -> Column:  # -0.0 equals 0.0
        return _c(f.name) + F.lit(0.0) if isinstance(f.dataType, (DoubleType, FloatType)) else _c(f.name)
    rows = df.withColumn("_hash", F.xxhash64(*[plain(f) for f in df.schema.fields]))
    again = materialize(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"))
    some = again.limit(REPEATED + 1).count()
    if not some:
        return df
    if some > REPEATED:
        return df.dropDuplicates()
    once = rows.join(again, "_hash", "left_anti")
    more = rows.join(again, "_hash", "left_semi").dropDuplicates(df.columns)
    return once.union(more).select(*df.columns)


def rank_report(df: DataFrame, distinct: bool = True) -> DataFrame:
    """The published report: the ten columns and four flags, without the
    helper columns; exact duplicate rows removed."""
    # the flags follow from a row's columns: equal rows have equal flags
    return assortment_flags(df, rows=distinct_rows(df) if distinct else None).drop("in_W1_not_W2")
