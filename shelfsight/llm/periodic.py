"""Periodic runs of words, found on a grammar of the texts.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) of at least ``max(min_length, 2 * q)`` words that no neighbouring
word extends. ``collapsed`` keeps of every run only its first q words.

Method (each slice of a scan partition by itself; words are numbered exactly,
no hash decides a result)
  1. In a run, the first ``g = ceil(min_length / 2)`` words of it come again q
     words later, and the repeated g-word windows of a run cover it. So only
     stretches covered by windows that repeat inside their stretch can hold
     runs; the rest is cut away, again and again until nothing changes. (Window
     hashes are used here: a collision only keeps a stretch longer.)
  2. Re-Pair on the word numbers of what is left, all texts of the slice
     together: every round replaces the pairs that are more frequent than
     their neighbours by new symbols, until no pair repeats. What remains of a
     stretch becomes a balanced tree of further symbols. Every derivation
     position of every symbol is noted.
  3. The runs that cross a symbol's boundary are computed once, at its first
     position: windows at the boundary that come again inside the symbol name
     the periods, common extensions to both sides give the ends. Extensions
     compare ranks of 1, 2, 4, ... words, which are exact.
  4. They are translated to all positions of the symbol. A run lies whole in
     the lowest symbol that holds it and crosses its boundary, so its full
     interval is among them; intervals inside another of the same period go.

Defined results for odd input: NULL text has no words (no runs, empty
collapsed text); rows are judged one by one, whatever their doc_id; an empty
table gives an empty result; other columns are ignored. Work and memory follow
the slice (4 MB of text, or one longer text).
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm import wordhash as wh
from shelfsight.llm.common import SPACE_CLASS, text_rows

MIN_LENGTH = 12
_SLICE, _CHUNK = 4 << 20, 1 << 21
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense numbers of the pairs (a, b)."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _stretches(words: np.ndarray, doc: np.ndarray, g: int, least: int):
    """(places, stretch numbers) of the words that can be in a run."""
    place, part = np.arange(len(words)), doc
    while len(place) >= least:
        n = len(place) - g + 1
        inside = np.flatnonzero(part[:n] == part[g - 1:])
        key = part[inside].astype(np.uint64)
        for j in range(g):
            key = key * _STEP + words[place[inside + j]].astype(np.uint64)
            key ^= key >> np.uint64(29)
        ordered = np.sort(key)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(again):
            break
        at = np.minimum(np.searchsorted(again, key), len(again) - 1)
        marks = np.zeros(len(place) + 1, np.int64)
        hit = inside[again[at] == key]
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + g, -1)
        covered = np.flatnonzero(np.cumsum(marks[:-1]))
        new = np.ones(len(covered), bool)
        new[1:] = (np.diff(covered) > 1) | (np.diff(part[covered]) != 0)
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] >= least
        number = np.unique(number[keep], return_inverse=True)[1]
        done = len(number) == len(place)
        place, part = place[covered[keep]], number
        if done:
            return place, part
    return place[:0], part[:0]


class _Text:
    """Exact comparisons on stretches that are parted by unique symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
        while True:
            low, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            if 2 * step > self.n or int(low.max()) + 1 == len(low):
                break
            self.ranks.append(_ranks(low[:-step], low[step:]))

    def grams(self, g: int) -> np.ndarray:
        """A number per window of ``g`` words."""
        k = min(g.bit_length() - 1, len(self.ranks) - 1)
        out, size = self.ranks[k], 1 << k
        while size < g:
            more = min(size, g - size)
            out = _ranks(out[:self.n - size - more + 1], self.ranks[k][size + more - (1 << k):][:self.n - size - more + 1])
            size += more
        return out

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from i < j on."""
        i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, step = self.ranks[k], 1 << k
            top = len(r) - 1
            same = (j <= top) & (r[np.minimum(i, top)] == r[np.minimum(j, top)])
            n += same * step
            i += same * step
            j += same * step
        return n

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words that end before i < j."""
        i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, step = self.ranks[k], 1 << k
            same = (i >= step) & (r[np.maximum(i - step, 0)] == r[np.maximum(j - step, 0)])
            n += same * step
            i -= same * step
            j -= same * step
        return n


def _grammar(symbols: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, ...]:
    """(symbol, left, middle, right) of every derivation position.
    ``stretch`` is -1 at the unique symbols that part stretches."""
    s, at, own = symbols.astype(np.int64), np.arange(len(symbols) + 1), stretch
    fresh, out = int(s.max()) + 1, []

    def replace(where: np.ndarray, names: np.ndarray):
        nonlocal s, at, own
        out.append((names, at[where], at[where + 1], at[where + 2]))
        s[where] = names
        keep = np.ones(len(s), bool)
        keep[where + 1] = False
        s, own, at = s[keep], own[keep], at[np.append(keep, True)]

    while len(s) > 1:
        pair = s[:-1] * fresh + s[1:]
        pair[(own[:-1] < 0) | (own[1:] < 0)] = -1
        kinds, kind, count = np.unique(pair, return_inverse=True, return_counts=True)
        # the most frequent first; pairs of one count in a mixed order
        mixed = (wh.mix(kinds.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        weight = np.where((kinds >= 0) & (count > 1), (count.astype(np.int64) << 32) + mixed, 0)[kind]
        near = np.concatenate([[0], weight, [0]])
        first = np.flatnonzero((weight > 0) & (weight >= near[:-2]) & (weight >= near[2:]))
        if not len(first):
            break
        # neighbours are of one pair here (a a a ...): take every second
        head = np.ones(len(first), bool)
        head[1:] = np.diff(first) > 1
        first = first[(first - first[head][np.cumsum(head) - 1]) % 2 == 0]
        names, name = np.unique(kind[first], return_inverse=True)
        replace(first, fresh + name)
        fresh += len(names)
    while True:
        head = np.ones(len(own), bool)
        head[1:] = own[1:] != own[:-1]
        place = np.arange(len(own)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        first = np.flatnonzero((own[:-1] == own[1:]) & (own[:-1] >= 0) & (place[:-1] % 2 == 0))
        if not len(first):
            break
        replace(first, fresh + np.arange(len(first)))
        fresh += len(first)
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spread(lo: np.ndarray, hi: np.ndarray):
    """(row, value) for every value of the ranges lo:hi."""
    size = hi - lo
    row = np.repeat(np.arange(len(lo)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + lo[row]


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Rows that begin a group of all keys but the last, the least last key."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys[:-1]], axis=0)
    return order[new]


def _crossing(text: _Text, symbol, left, middle, right, g: int, least: int):
    """(symbol number, start, end, period) of the runs inside each symbol."""
    gram = text.grams(g)
    by_gram = np.argsort(gram, kind="stable")
    key = gram[by_gram] * text.n + by_gram
    found = []
    anchor = middle[:, None] + np.arange(-g, 1)
    fits = (anchor >= left[:, None]) & (anchor + g <= right[:, None])
    row, col = np.nonzero(fits)
    anchor = anchor[row, col]
    lo = np.searchsorted(key, gram[anchor] * text.n + left[row])
    hi = np.searchsorted(key, gram[anchor] * text.n + right[row] - g, "right")
    total = np.cumsum(hi - lo)
    a = 0
    while a < len(anchor):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _CHUNK)))
        at, other = _spread(lo[a:b], hi[a:b])
        i, j, x = anchor[a:b][at], by_gram[other], row[a:b][at]
        i, j = np.minimum(i, j), np.maximum(i, j)
        q = j - i
        some = (q > 0) & (2 * q <= right[x] - left[x])
        i, j, q, x = i[some], j[some], q[some], x[some]
        start = np.maximum(left[x], i - text.before(i, j))
        end = np.minimum(right[x], j + text.after(i, j))
        some = end - start >= np.maximum(least, 2 * q)
        x, start, end, q = x[some], start[some], end[some], q[some]
        some = _first_of(x, start, end, q)
        found.append((x[some], start[some], end[some], q[some]))
        a = b
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    x, start, end, q = (np.concatenate(c) for c in zip(*found, strict=True))
    some = _first_of(x, start, end, q)
    return symbol[x[some]], start[some] - left[x[some]], end[some] - left[x[some]], q[some]


def runs_of(words: np.ndarray, doc: np.ndarray, least: int = MIN_LENGTH):
    """(start, end, period) of all runs of the numbered words of several
    texts, sorted by start and period; ``doc`` never falls."""
    g = (least + 1) // 2
    place, part = _stretches(words, doc, g, least)
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none
    # one unique symbol behind every stretch
    n = int(part[-1]) + 1
    spot = np.arange(len(part)) + part
    symbols = np.empty(len(part) + n, np.int64)
    stretch = np.full(len(symbols), -1)
    top = int(words.max()) + 1
    symbols[np.flatnonzero(np.isin(np.arange(len(symbols)), spot, invert=True))] = top + np.arange(n)
    symbols[spot], stretch[spot] = words[place], part
    origin = np.zeros(len(symbols), np.int64)
    origin[spot] = place
    text = _Text(symbols)
    name, left, middle, right = _grammar(symbols, stretch)
    long = right - left >= least
    name, left, middle, right = name[long], left[long], middle[long], right[long]
    once = _first_of(name, left)
    symbol, start, end, period = _crossing(text, name[once], left[once], middle[once], right[once], g, least)
    # to every derivation position
    order = np.argsort(symbol, kind="stable")
    symbol, start, end, period = symbol[order], start[order], end[order], period[order]
    row, run = _spread(np.searchsorted(symbol, name), np.searchsorted(symbol, name, "right"))
    start, end, period = start[run] + left[row], end[run] + left[row], period[run]
    # intervals inside another of the same period go
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = np.maximum.accumulate(end + period * (len(symbols) + 1)) if len(end) else end
    keep = np.ones(len(end), bool)
    keep[1:] = end[1:] + period[1:] * (len(symbols) + 1) > reach[:-1]
    start, end, period = start[keep], end[keep], period[keep]
    some = _first_of(start, end, period)
    start, end, period = origin[start[some]], origin[end[some] - 1] + 1, period[some]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _slice_runs(column: pa.Array, least: int):
    """(words, starts, ends, periods) of every text; starts and ends are word
    numbers of the text."""
    lists = [t.split() for t in column.to_pylist()]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = list(chain.from_iterable(lists))
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    words = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    first = np.cumsum(sizes) - sizes
    start, end, period = runs_of(words, np.repeat(np.arange(len(lists)), sizes), least)
    cut = np.searchsorted(start, np.append(first, len(flat)))
    for i, w in enumerate(lists):
        a, b = cut[i], cut[i + 1]
        yield w, start[a:b] - first[i], end[a:b] - first[i], period[a:b]


def _collapsed(words: list[bytes], start, end, period) -> bytes:
    if not len(start):
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, end, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)])


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and
    the collapsed text of every row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(it):
        for batch in wh.batches(it, _SLICE):
            sizes, runs, texts = [], [], []
            for words, start, end, period in _slice_runs(batch.column("text"), min_length):
                sizes.append(len(words))
                runs.append([{"start": s, "length": e - s, "period": p}
                             for s, e, p in zip(start.tolist(), end.tolist(), period.tolist(), strict=True)])
                texts.append(_collapsed(words, start, end, period).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind),
                                              pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
    return text_rows(docs).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the texts of a tenth of the ids repeat: with h =
    crc32(doc_id), g = h div 10 and h % 10 = 0, the words from a = g % n on are
    the p = 1 + (n - a) div (3 + g % 8) words from a on, again and again. A
    NULL doc_id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", f"{SPACE_CLASS}+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.expr("crc32(cast(doc_id AS string)) div 10").alias("g"),
                       F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    a = F.col("g") % F.col("n")
    p = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))

    def word(i: Column) -> Column:
        return F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")
    some = F.col("n") > 0
    return rows.withColumn("a", F.when(some, a)).withColumn("p", F.when(some, p)).select(
        "doc_id", F.when(some, planted).otherwise(F.col("text")).alias("text"))
