"""Secret scan with multipart credential linking.

Base findings (leftmost, non-overlapping per kind): ``assign`` (a keyword, a
sign and a value of 12 or more characters), ``access`` (``AKIA...``, 18 or
more) and ``hex`` (16 or more). They are always reported.

Weak candidates are parts that mean little alone:
  login     an account name behind a keyword     (an access identifier)
  short     a keyword with a value of 6-11       (a secret)
  endpoint  a URL or a host behind a keyword     (an endpoint)
Their roles, with those of the base findings (access: identifier; assign and
hex: secret), decide: a weak candidate is reported only when a part of a
complementary role co-occurs in the same scope (a block without an empty
line, however long). Complementary: identifier with secret, secret with
identifier or endpoint, endpoint with secret.

Linking is a join by scope: the parts of one document and scope are reduced to
the roles the scope holds, and a candidate meets that one row however many
parts a document holds. Everything is DataFrame expressions; only documents
with candidates leave the scan, as positions without text.

Spans are code points, end exclusive, over the whole match.

Defined results for odd input: NULL text is empty; each row of ``docs`` gives
one row whatever its doc_id (rows are told apart by a row number of the scan);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfsight.llm.common import text_column, written

ROLES = {"assign": "secret", "access": "identifier", "hex": "secret",
         "login": "identifier", "short": "secret", "endpoint": "endpoint"}
KINDS = ("assign", "access", "hex", "login", "short", "endpoint")  # also the order of ties
BASE_KINDS = KINDS[:3]
NEEDS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

_VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?({_VALUE})"""
ACCESS = r"AKIA[A-Z0-9]{14,}"       # 18 or more in all
HEX = r"[0-9a-f]{16,}"
LOGIN = r"""(?i:\b(user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
ENDPOINT = r"""(?i:https?://[a-z0-9][a-z0-9.-]+(?::[0-9]+)?(?:/[^\s"'<>]*)?|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9][a-z0-9.-]{2,}(?::[0-9]+)?)"""
BREAK = r"\n[\x20\t\r]*\n"


def _parts(kind: str, pattern: str, value_group: int = 0, when: Column | None = None) -> Column:
    """Array of (kind, index, gap, size, value size): the k-th match starts
    ``gap`` code points after the end of the one before."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(value_group)) if value_group else found
    between = F.split("text", pattern, -1)
    zipped = F.transform(F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(between, 1, F.size(found)).alias("g")),
                         lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"),
                                               F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("size"),
                                               F.length(z["v"]).alias("value")))
    test = F.col("text").rlike(pattern) if when is None else when & F.col("text").rlike(pattern)
    return F.when(test, zipped).otherwise(F.array().cast(_PART_TYPE))


_PART_TYPE = "array<struct<kind:string,idx:int,gap:int,size:int,value:int>>"


def _placed(docs: DataFrame) -> DataFrame:
    """One row per part with its place (row, kind, start, end, value), and
    one with a NULL kind for a document without parts."""
    text = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_column().alias("text"))
    step = text.select("*", *(_parts(k, p, g).alias(f"p_{k}") for k, p, g in (
        ("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("login", LOGIN, 2), ("endpoint", ENDPOINT, 0))))
    # scopes matter only where a weak candidate meets another part
    weak = (F.size("p_login") > 0) | (F.size("p_endpoint") > 0) | F.exists(
        "p_assign", lambda x: x["value"] < 12)
    several = sum((F.size(f"p_{k}") for k in ("access", "hex", "login", "endpoint")), F.size("p_assign")) > 1
    step = step.select("*", _parts("break", BREAK, when=weak & several).alias("p_break"))
    every = F.concat(*(f"p_{k}" for k in ("assign", "access", "hex", "login", "endpoint", "break")))
    rows = step.select("row", "doc_id", F.explode_outer(every).alias("p")).select("row", "doc_id", "p.*")
    so_far = W.partitionBy("row", "kind").orderBy("idx")
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    return rows.select("row", "doc_id", "kind", "value", (end - F.col("size")).alias("start"), end.alias("end"))


def find_secrets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, linked): every part with its place, and the weak candidates
    among them that a complementary part of their scope makes reportable."""
    placed = _placed(docs)
    kind = (F.when(F.col("kind") != "assign", F.col("kind"))
             .when(F.col("value") >= 12, "assign").when(F.col("value") >= 6, "short"))
    scope = F.sum((F.col("kind") == "break").cast("int")).over(
        W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = placed.select("row", "doc_id", kind.alias("kind"), "start", "end", scope.alias("scope"))
    # one row per document stays, so that documents without findings are returned
    parts = parts.where("kind IS NULL OR kind <> 'break'")
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[F.col("kind")]
    # positions only (no text): written once, read by both sides of the join
    parts = written(parts.withColumn("role", role))
    held = parts.where("role IS NOT NULL").groupBy("row", "scope").agg(
        *(F.max(F.col("role") == r).alias(r) for r in NEEDS))
    weak = parts.where(F.col("kind").isin(*(k for k in KINDS if k not in BASE_KINDS)))
    fits = F.lit(False)
    for r, others in NEEDS.items():
        for o in others:
            fits = fits | ((F.col("role") == r) & F.col(o))
    linked = weak.join(held, ["row", "scope"]).where(fits).select("row", "kind", "start")
    return parts, linked


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans``, an array of (start, order,
    kind, end) sorted by start and kind order."""
    parts, linked = find_secrets(docs)
    reported = parts.join(linked.withColumn("linked", F.lit(True)), ["row", "kind", "start"], "left")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    keep = F.col("kind").isin(*BASE_KINDS) | F.col("linked")
    item = F.when(keep, F.struct(F.col("start"), order.alias("order"), F.col("kind"), F.col("end")))
    return reported.groupBy("row").agg(F.first("doc_id").alias("doc_id"),
                                       F.array_sort(F.collect_list(item)).alias("spans")).drop("row")


def joined(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
