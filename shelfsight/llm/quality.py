"""Quality rules: a threshold table compiled into one projection.

Each rule names a metric and the range a good document keeps to. The table is
compiled into DataFrame expressions over columns computed once per row: no
Python runs on the executors and nothing is shuffled.

Metrics (word = maximal run outside ``\\x20\\x09-\\x0D``):
  n_words, word_chars (code points in words), n_symbols (``[#*$%&|<>]``),
  n_dup_lines (\\n-split lines holding a word that equal an earlier line),
  n_repeat_words (words inside 5-word windows found twice or more in the text,
  the first one included), n_stop_words, n_upper (A-Z), n_lines (lines
  holding a word).

``base_failed``: n_words < 10 or 100 * n_repeat_words > 20 * n_words.
``kept``: not base_failed and no rule of the table broken.

Repeated windows: 64-bit window hashes that are all distinct prove that no
window repeats; only other texts compare the window strings themselves
(sorted next to each other), so the count is exact.

Defined results for odd input: a NULL text has no words (all counts 0,
base_failed); every row gives one row, whatever its doc_id; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import SPACE_CLASS, text_column

# Frequent function words of the four languages.
STOP_WORDS = (
    "a an and are as at be by for from have in is it not of on or that the this to was with "
    "au avec ce dans de des du elle en est et il je la le les ne ou par pas pour que qui se sur un une "
    "als auch auf aus das dem den der des die ein eine es für im ist mit nicht sich und von war zu "
    "al como con del el en es la las lo los no para por que se su un una y"
).split()

# A filter on a column that is not deterministic is not pushed below the
# projection that makes it: without it the optimizer would write out every
# metric's expression again inside the filter, and again inside those.
_STEP = "__metrics_step"

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high`` for texts of at least
    ``min_words`` words; compared as integers scaled by 1000."""
    name: str
    numerator: str
    denominator: str
    low: int | None = None    # thousandths
    high: int | None = None
    min_words: int = 0

    def broken(self) -> Column:
        value, base = 1000 * F.col(self.numerator), F.col(self.denominator)
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (value < self.low * base)
        if self.high is not None:
            bad = bad | (value > self.high * base)
        return (F.col("n_words") >= self.min_words) & bad


RULES = (
    Rule("word_length", "word_chars", "n_words", low=2000, high=14000),
    Rule("symbols", "n_symbols", "word_chars", high=50),
    Rule("upper_case", "n_upper", "word_chars", high=400),
    Rule("stop_words", "n_stop_words", "n_words", low=20, min_words=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=500),
)


def _words(text: Column) -> Column:
    """Words of a text, without empty pieces at its ends."""
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def _repeat_words(w: Column, n: Column, hashes: Column) -> Column:
    strings = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                          lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("s"), i.alias("i")))

    def covered(a):  # a: (window text, position) sorted by text
        m = F.size(a)
        twice = F.filter(a, lambda x, k: ((k > 0) & (F.get(a, k - 1)["s"] == x["s"]))
                         | ((k < m - 1) & (F.get(a, k + 1)["s"] == x["s"])))
        return F.size(F.array_distinct(F.flatten(F.transform(
            twice, lambda x: F.sequence(x["i"], x["i"] + (WINDOW - 1))))))
    exact = F.transform(F.array(F.sort_array(strings)), covered)[0]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(exact)


def metrics(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the ``carry`` columns and the metrics, one row per row."""
    keys = ["doc_id", *(carry or [])]
    step = docs.select(*keys, text_column().alias("text"))
    step = step.select(*keys, "text", _words(F.col("text")).alias("w"),
                       F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    step = step.select(
        *keys, "w", "lines", F.size("w").alias("n"),
        F.length(F.regexp_replace("text", SPACE_CLASS, "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"))
    hashes = F.when(F.col("n") > WINDOW, F.transform(
        F.sequence(F.lit(0), F.col("n") - WINDOW),
        lambda i: F.xxhash64(*(F.get(F.col("w"), i + k) for k in range(WINDOW))))).otherwise(
            F.array().cast("array<long>"))
    stop = F.size(F.filter("w", lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?")).isin(*STOP_WORDS)))
    step = step.select("*", hashes.alias("hashes"), stop.cast("long").alias("n_stop_words"))
    return step.select(
        *keys, F.col("n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w"), F.col("n"), F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.spark_partition_id().alias(_STEP), "n_stop_words", F.col("n_upper").cast("long").alias("n_upper"), F.size("lines").cast("long").alias("n_lines"))


def apply_rules(docs: DataFrame, rules=RULES, carry: list[str] | None = None) -> DataFrame:
    """The metrics, base_failed, broken_rules (names) and kept; ``carry``
    names columns of ``docs`` to keep (none may be named like a metric)."""
    m = metrics(docs, carry)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = F.filter(F.array(*(F.when(r.broken(), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    return m.select("*", base.alias("base_failed"), broken.alias("broken_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def good_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs``, with their columns, that the rules keep."""
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "doc_id", "text")
    judged = apply_rules(whole, rules, carry=["row"])
    return judged.where(F.col("kept") & (F.col(_STEP) >= 0)).select(*(F.col(f"row.`{c}`").alias(c) for c in names))
