"""Benchmark decontamination with an FM-index per training shard.

Words are the maximal runs of ``[0-9a-z]`` and non-ASCII characters after
A-Z is lower-cased. A window is 13 consecutive words of a benchmark item; an
item with fewer words (but not none) is one window. A document word inside
any occurrence of a window is hit; a document is contaminated when it has a
hit and ``share * n_hit >= n_words``.

Method: each Arrow slice of documents is a training shard. Its words become
integers of the benchmark's vocabulary (any other word is a separator, and
runs between separators that are shorter than the shortest window are left
out: neither can hold an occurrence). Over that sequence a shard builds a
suffix array, the BWT and a wavelet matrix, searches all windows backwards at
once by wavelet ranks, walks LF steps from each match row to a sampled suffix
position, and merges the located spans per document.

The benchmark is broadcast in slices of at most ``max_words`` words (a
documented bound; the number of slices follows the benchmark, and every slice
is searched in every document by a pass of its own), so a task holds the index
of one slice. A single item is never split.

Defined results for odd input: NULL text has no words; a row of ``docs`` gives
one row whatever its doc_id (NULL and repeated ones too); repeated item_ids
count once, a NULL item_id reads as the text ``null``; with an empty benchmark
nothing is hit; extra columns are ignored by ``find_contamination``.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm import wordhash as wh
from shelfsight.llm.common import text_rows

WINDOW = 13
SHARE = 20
MAX_BENCHMARK_WORDS = 2_000_000
SAMPLE = 8  # every SAMPLE-th text position keeps its suffix-array entry

# byte -> its lower-case word byte, or a space
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Patterns:
    """Distinct windows of one benchmark slice, as vocabulary ids."""

    def __init__(self, items, window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            words = words_of(text or b"")
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                owners.setdefault(tuple(ids[i:i + size]), set()).add("null" if item is None else str(item))
        self.owners = [sorted(v) for v in owners.values()]
        self.length = np.array([len(k) for k in owners], np.int64)
        self.shortest = int(self.length.min()) if owners else 0
        self.codes = np.zeros((len(owners), int(self.length.max()) if owners else 0), np.int64)
        for i, k in enumerate(owners):
            self.codes[i, self.codes.shape[1] - len(k):] = k


class FMIndex:
    """Suffix array, BWT and wavelet matrix of an integer sequence."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        order = _suffix_array(text)
        self.bwt = text[order - 1]  # position 0 takes the last symbol
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])[:n_symbols]
        self.sampled = order % SAMPLE == 0
        self.order = np.where(self.sampled, order, -1)
        self.start = int(np.flatnonzero(order == 0)[0])  # row of the whole text
        self.n, self.levels = n, []
        level = self.bwt.copy()
        for bit in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            ones = (level >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones)])
            self.levels.append((bit, zeros, int(zeros[-1])))
            level = np.concatenate([level[ones == 0], level[ones == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in ``bwt[:i]`` (elementwise)."""
        low = np.zeros_like(i)
        for bit, zeros, total in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            zi, zl = zeros[i], zeros[low]
            i = np.where(one, total + i - zi, zi)
            low = np.where(one, total + low - zl, zl)
        return i - low

    def search(self, codes: np.ndarray, length: np.ndarray):
        """Half-open row interval of every right-aligned pattern."""
        lo, hi = np.zeros(len(codes), np.int64), np.full(len(codes), self.n, np.int64)
        for step in range(codes.shape[1]):
            c = codes[:, codes.shape[1] - 1 - step]
            live = np.flatnonzero((step < length) & (lo < hi))
            if not len(live):
                break
            s = c[live]
            lo[live] = self.first[s] + self.rank(s, lo[live])
            hi[live] = self.first[s] + self.rank(s, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by LF steps to a sample."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        steps = 0
        while len(todo):
            done = self.sampled[rows[todo]]
            out[todo[done]] = self.order[rows[todo[done]]] + steps
            todo = todo[~done]
            r = rows[todo]
            s = self.bwt[r]
            step = self.first[s] + self.rank(s, r)
            # the last separator has nothing behind it: it sorts first among
            # the separators, and the whole text's row does not precede one
            rows[todo] = np.where(s == 0, step + 1 - (r > self.start), step)
            steps += 1
        return out


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; a suffix sorts before its extensions."""
    n = len(text)
    rank = text.astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - k] = rank[k:]
        key = rank * (int(rank.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[1], (np.diff(key[order]) > 0).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n or k >= n:
            return order
        k *= 2


def search_shard(texts, patterns: Patterns):
    """(n_words, starts, ends, item lists) per document of one shard."""
    get, ids, sizes = patterns.vocab.get, [], []
    for t in texts:
        words = words_of(t)
        ids.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        sizes.append(len(words))
    bounds = np.cumsum([0, *(n + 1 for n in sizes)])
    flat = np.zeros(bounds[-1], np.int32)
    for a, x in zip(bounds, ids, strict=False):
        flat[a:a + len(x)] = x
    starts, ends, items = ([[] for _ in sizes] for _ in range(3))
    inside = np.concatenate([[0], (flat > 0).astype(np.int8), [0]])
    edge = np.diff(inside)
    run_a, run_b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = run_b - run_a >= max(1, patterns.shortest)
    run_a, run_b = run_a[long], run_b[long]
    if len(run_a) and len(patterns.length):
        # every kept run is followed by one separator
        size = run_b - run_a + 1
        at = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(at[-1]) + np.repeat(run_a - at[:-1], size)
        text = flat[place].astype(np.int64)
        text[at[1:] - 1] = 0
        fm = FMIndex(text, len(patterns.vocab) + 1)
        lo, hi = fm.search(patterns.codes, patterns.length)
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
        found = place[fm.locate(rows)]
        doc = np.searchsorted(bounds, found, side="right") - 1
        order = np.lexsort((which, found))
        for d, s, p in zip(doc[order].tolist(), (found - bounds[doc])[order].tolist(), which[order].tolist(),
                           strict=True):
            starts[d].append(s)
            ends[d].append(s + int(patterns.length[p]))
            items[d].append(p)
    owners = patterns.owners
    return sizes, starts, ends, [sorted({o for p in x for o in owners[p]}) for x in items]


def _merge(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(rows: DataFrame, shared) -> DataFrame:
    def run(it):
        patterns = Patterns(shared.value)
        for batch in wh.batches(it):
            sizes, starts, ends, items = search_shard(batch.column("text").to_pylist(), patterns)
            spans = [[{"start": s, "end": e} for s, e in _merge(a, b)] for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c != "text"]
                + [pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                [*(c for c in batch.schema.names if c != "text"), "n_words", "spans", "items"])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, ", ".join(
        [*kept, "n_words long", "spans array<struct<start:long,end:long>>", "items array<string>"]))


def benchmark_slices(benchmark: DataFrame, max_words: int = MAX_BENCHMARK_WORDS):
    """Broadcasts of at most about ``max_words`` words each."""
    rows = benchmark.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a word is at least one character, and words are a separator apart
    total = rows.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0
    n = int(total // max_words) + 1
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        items = [(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()]
        yield benchmark.sparkSession.sparkContext.broadcast(items)


def find_contamination(docs: DataFrame, benchmark: DataFrame, share: int = SHARE,
                       max_words: int = MAX_BENCHMARK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), spans (word ranges to remove)
    and contaminated, one row per row of ``docs``."""
    slices = list(benchmark_slices(benchmark, max_words))
    if len(slices) == 1:
        out = _scan(text_rows(docs), slices[0])
    else:
        out = _combined([_scan(text_rows(docs).withColumn("digest", F.md5("text")).withColumn("part", F.lit(i)), s)
                         for i, s in enumerate(slices)])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _combined(scans: list[DataFrame]) -> DataFrame:
    """One row per document from its rows of all slices. Rows are told apart
    by (doc_id, digest of the text); repeats of both are counted and given
    back. A group gathers at most one distinct result per slice."""
    rows = scans[0]
    for s in scans[1:]:
        rows = rows.union(s)
    merged = rows.groupBy("doc_id", "digest").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum(F.when(F.col("part") == 0, 1).otherwise(0)).alias("copies"))
    # overlapping spans of different slices become one
    joined = F.aggregate(
        "spans", F.array().cast("array<struct<start:long,end:long>>"),
        lambda a, x: F.when((F.size(a) > 0) & (x["start"] <= F.element_at(a, -1)["end"]),
                            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                                F.element_at(a, -1)["start"].alias("start"),
                                F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")))
                            .cast("array<struct<start:long,end:long>>")))
        .otherwise(F.concat(a, F.array(x).cast("array<struct<start:long,end:long>>"))))
    return merged.select("doc_id", "n_words", joined.alias("spans"), "items",
                         F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
