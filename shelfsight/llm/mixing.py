"""Mixing sources to target weights by hierarchical budgets.

The tree has one level per column of ``levels`` (domain, language, source).
A budget of tokens enters at the root. At every node it is shared among the
children by weight, no child getting more than its subtree can supply
(``max_epochs`` times its tokens); what a child cannot take goes to its
siblings by their weights, and only what the whole family cannot take was
never given to it, i.e. went to the siblings of an ancestor. This is the
water-filling rule; per family it is one pass over the children in order of
capacity / weight. All amounts are whole tokens (floors), so the result is
exact and never above a capacity or the budget.

Each leaf then gives the prefix of its seeded order: documents of a leaf are
ordered by md5(seed, epoch, doc_id), then by md5 of their text; without a
doc_id the text stands for it. Whole epochs are taken while the amount lasts,
and of the next epoch the longest prefix that stays within it. The prefix ends
at one order key per leaf, found in two steps that never sort a leaf in one
task: totals per (leaf, first three hex digits) are summed up, and only the
slice in which the amount ends (1/4096 of the leaf) is ordered document by
document. The documents are then a filter against one row per leaf. Rows equal
in id and text share one key; where the prefix ends among them, they are
numbered over the tasks and as many taken as fit.

Tokens of a document are its words (maximal runs outside
``\\x20\\x09-\\x0D``).

Defined results for odd input: NULL text has no tokens (such documents belong
to every prefix whose end lies after them); NULL level values are a node of
their own, written ``<null>``; a value without a weight has the default
weight; weight 0 gives nothing; rows that repeat a doc_id are taken one by
one; an empty table gives an empty result; other columns pass through, but for
one named ``mix_epoch``, which the result's replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.llm.common import SPACE_CLASS, text_column, written

BIG = "decimal(38,0)"


def n_tokens(text: Column) -> Column:
    """Words of a text."""
    return (F.size(F.split(F.concat(F.lit(" "), text), f"{SPACE_CLASS}+"))
            - F.when(F.concat(F.lit(" "), text).rlike(rf"{SPACE_CLASS}\z"), 2).otherwise(1)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column, digest: Column) -> Column:
    """``digest`` is the md5 of the text."""
    first = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), digest)))
    return F.concat(first, digest)


def weight_of(column: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for value, w in weights.items():
        out = F.when(F.col(column) == value, w).otherwise(out)
    return out.cast(BIG)


def _shared(children: DataFrame, family: list[str], name: str) -> DataFrame:
    """``children`` (family columns, name, budget of the family, weight,
    capacity) with the amount each gets."""
    order = W.partitionBy(*family).orderBy(F.col("ratio"), name)
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*family)
    step = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity").cast("double")
                                               / F.col("weight").cast("double")).otherwise(F.lit(float("inf"))))
    step = step.select("*", F.coalesce(F.sum("capacity").over(upto), F.lit(0)).cast(BIG).alias("below"),
                       (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
                        ).cast(BIG).alias("rest"))
    # a child is full when its share of what is left would exceed its capacity
    full = (F.col("weight") > 0) & (F.col("capacity") * F.col("rest") <= F.col("weight") * (F.col("budget") - F.col("below")))
    step = step.withColumn("full", full)
    filled = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)).cast(BIG)
    open_w = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole).cast(BIG)
    share = F.expr("(budget - filled) * weight div open_w")
    return step.select("*", filled.alias("filled"), open_w.alias("open_w")).withColumn(
        "amount", F.when(F.col("full"), F.col("capacity")).when(F.col("weight") > 0, share).otherwise(F.lit(0))
        .cast(BIG)).drop("ratio", "below", "rest", "full", "filled", "open_w")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], default: int, budget: Column,
                 max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with the ``amount`` of every leaf. ``budget``
    is an expression over the one row (total)."""
    tree = leaves.select(*levels, F.col("tokens").cast(BIG).alias("tokens"))
    given = None
    for depth, name in enumerate(levels):
        family = levels[:depth]
        children = tree.groupBy(*levels[:depth + 1]).agg(
            (F.sum("tokens") * max_epochs).cast(BIG).alias("capacity"))
        children = children.withColumn("weight", weight_of(name, weights[depth], default))
        if family:
            children = children.join(given.withColumnRenamed("amount", "budget"), family)
        else:  # the root's family: one row per top-level value
            total = (F.sum("capacity").over(W.partitionBy()) / max_epochs).cast(BIG)
            children = children.withColumn("total", total).withColumn(
                "budget", F.least(budget.cast(BIG), (F.col("total") * max_epochs).cast(BIG))).drop("total")
        given = _shared(children, family, name).select(*levels[:depth + 1], "amount")
    return leaves.join(given, levels)


def mix(docs: DataFrame, levels: list[str], weights: list[dict[str, int]], budget: Column, seed: int = 0,
        max_epochs: int = 1, default_weight: int = 1) -> DataFrame:
    """The selected rows of ``docs`` with their ``mix_epoch`` (a row comes
    once per epoch it is selected in). ``levels`` are columns of ``docs``;
    ``budget`` is an expression over ``total`` (all tokens)."""
    names = [c for c in docs.columns if c != "mix_epoch"]
    keys = [f"l{i}" for i in range(len(levels))]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"),
        *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("<null>")).alias(k) for k, c in zip(keys, levels, strict=True)),
        F.col("doc_id").cast("string").alias("id"), n_tokens(text_column()).alias("n"), F.md5(text_column()).alias("digest"))
    light = written(rows.drop("row"))
    leaves = light.groupBy(*keys).agg(F.sum("n").alias("tokens"))
    plan = leaf_budgets(leaves, keys, weights, default_weight, budget, max_epochs)
    plan = written(plan.select(*keys, "tokens", F.col("amount").cast("long").alias("amount"))
                   .withColumn("epochs", F.expr("CASE WHEN tokens > 0 THEN amount div tokens ELSE 0 END").cast("int"))
                   .withColumn("rest", F.col("amount") - F.col("epochs") * F.col("tokens")))

    # where the last, partial epoch of a leaf ends
    partial = plan.where("rest > 0").select(*keys, "epochs", "rest")
    key = order_key(seed, F.col("epochs"), F.col("id"), F.col("digest"))
    ordered = light.join(partial, keys).withColumn("k", key).withColumn("slice", F.substring("k", 1, 3))
    slices = ordered.groupBy(*keys, "slice").agg(F.sum("n").alias("s"), F.first("rest").alias("rest"))
    run = W.partitionBy(*keys).orderBy("slice")
    slices = slices.withColumn("upto", F.sum("s").over(run))
    cut = written(slices.where("upto > rest").groupBy(*keys).agg(
        F.min(F.struct("slice", (F.col("rest") - (F.col("upto") - F.col("s"))).alias("left"))).alias("m"))
        .select(*keys, "m.slice", "m.left"))
    inside = ordered.join(cut, [*keys, "slice"]).groupBy(*keys, "slice", "k", "left").agg(
        F.sum("n").alias("s"), F.max("n").alias("each"))
    inside = inside.withColumn("upto", F.sum("s").over(W.partitionBy(*keys).orderBy("k")))
    # the first key that does not fit as a whole, and how many of its rows do
    first_out = inside.where("upto > left").groupBy(*keys).agg(F.min(F.struct(
        "k", F.expr("(left - (upto - s)) div each").alias("fit"))).alias("end"))
    ends = written(plan.join(first_out, keys, "left").select(
        *(F.col(k).alias(f"{k}p") for k in keys), "epochs", "rest", F.col("end.k").alias("end"),
        F.coalesce("end.fit", F.lit(0)).alias("fit")))

    rows = rows.join(ends, [F.col(k) == F.col(f"{k}p") for k in keys])
    taken = (F.col("rest") > 0) & (F.col("end").isNull() | (key < F.col("end")))
    picked = rows.withColumn("times", F.col("epochs") + F.when(taken, 1).otherwise(0))
    if ends.where("fit > 0").limit(1).count():
        at_end = (F.col("fit") > 0) & F.coalesce(key == F.col("end"), F.lit(False))
        tied = _first_rows(picked.where(at_end), keys).withColumn("times", F.col("times") + 1)
        columns = ["row", "times"]
        picked = picked.where(~at_end).select(*columns).union(tied.where("fits").select(*columns)).union(
            tied.where("NOT fits").withColumn("times", F.col("times") - 1).select(*columns))
    return picked.where("times > 0").select("row.*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("mix_epoch"))


def _first_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``fits``: whether a row is among the first ``fit`` ones
    of its leaf. Rows are numbered inside the tasks that wrote them, behind
    the rows of the tasks before."""
    rows = written(rows.withColumn("at", F.monotonically_increasing_id())).withColumn("task", F.expr("shiftright(at, 33)"))
    sums = rows.groupBy(*keys, "task").agg(F.count("*").alias("size"))
    before = W.partitionBy(*keys).orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "task", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy(*keys, "task").orderBy("at"))
    return rows.withColumn("no", inside).join(sums, [*keys, "task"]).withColumn("fits", F.col("before") + F.col("no") <= F.col("fit"))
