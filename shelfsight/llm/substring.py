"""Removal of long word sequences that an earlier document already has.

Words are the maximal runs outside ``\\x20\\x09-\\x0D``, unchanged. A window is
``length`` (50) consecutive words of one document. A word is removed when a
window that covers it also starts in a document with a smaller doc_id;
windows are judged on the input, not on what is left.

Method (anchored first-owner join; see the README for why not one automaton
per reference shard):
  1. Every window names an anchor by its content: the smallest hash among its
     25-word runs. Equal windows name equal anchors. Equal texts are folded to
     their smallest doc_id (later ones lose every word).
  2. Anchors seen in two documents mark the only windows that can repeat.
  3. Those windows, as a 128-bit pair (anchor, window hash), are reduced to
     their smallest doc_id (partial sums before the shuffle) and joined back:
     a window with a smaller owner is removed.
  4. The removed window starts of a document are merged into maximal spans.

Defined results for odd input: NULL text has no words; rows that repeat a
doc_id never remove words from each other; a row with a NULL doc_id neither
removes nor loses words; an empty table gives an empty result; extra columns
are ignored. Repeated rows are each returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm import wordhash as wh
from shelfsight.llm.common import settled, text_rows, written

LENGTH = 50
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _anchors(words: np.ndarray, length: int) -> np.ndarray:
    """The anchor hash of every window of one document."""
    grams = wh.window_hashes(words, length // 2)
    return np.lib.stride_tricks.sliding_window_view(grams, length - length // 2 + 1).min(axis=1)


def _documents(batch, length: int):
    """(text bytes, word hashes) of every document of a slice."""
    words, _, _, bounds = wh.hash_words(*wh.buffers(batch.column("text")), lower=False)
    for t, a, b in zip(batch.column("text").to_pylist(), bounds[:-1], bounds[1:], strict=True):
        yield t, words[a:b]


def profile(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, sha (of the words joined by spaces), anchors."""
    def run(it):
        for batch in wh.batches(it):
            n, sha, anchors = [], [], []
            for t, w in _documents(batch, length):
                n.append(len(w))
                sha.append(hashlib.sha256(b" ".join(t.split())).hexdigest())
                anchors.append(np.unique(_anchors(w, length)) if len(w) >= length else np.zeros(0, np.uint64))
            offsets = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(anchors).view(np.int64)))],
                ["doc_id", "n_words", "sha", "anchors"])
    return text_rows(docs).mapInArrow(run, "doc_id long, n_words long, sha string, anchors array<long>")


def _windows(candidates: DataFrame, length: int) -> DataFrame:
    """One row per window whose anchor is in the document's shared list."""
    def run(it):
        for batch in wh.batches(it):
            cols = [[], [], [], []]
            for d, shared, (_, w) in zip(batch.column("doc_id").to_pylist(), batch.column("shared"),
                                         _documents(batch, length), strict=True):
                if len(w) < length:
                    continue
                anchor = _anchors(w, length)
                at = np.flatnonzero(np.isin(anchor, np.asarray(shared.values).view(np.uint64)))
                for c, x in zip(cols, (np.full(len(at), d, np.int64), at.astype(np.int32), anchor[at].view(np.int64),
                                       wh.window_hashes(w, length)[at].view(np.int64)), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                                 ["doc_id", "start", "anchor", "window"])
    return candidates.select("doc_id", "text", "shared").mapInArrow(
        run, "doc_id long, start int, anchor long, window long")


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, sha, n_removed, kept words and removed spans."""
    def run(it):
        for batch in wh.batches(it):
            out = [[], [], [], [], []]
            for d, starts, t in zip(batch.column("doc_id").to_pylist(), batch.column("starts"),
                                    batch.column("text").to_pylist(), strict=True):
                words = t.split()
                edge = np.zeros(len(words) + 1, np.int64)
                s = np.unique(np.asarray(starts.values))
                s = s[s + length <= len(words)]
                np.add.at(edge, s, 1)
                np.add.at(edge, s + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                spans = [{"start": int(a), "end": int(b)} for a, b in
                         zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                for c, x in zip(out, (d, hashlib.sha256(b" ".join(words)).hexdigest(), int(gone.sum()), kept, spans),
                                strict=True):
                    c.append(x)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.binary(), span),
                                                strict=True)], ["doc_id", "sha", "n_removed", "kept", "spans"])
    return rows.select("doc_id", "text", "starts").mapInArrow(
        run, "doc_id long, sha string, n_removed long, kept binary, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and for a
    document that lost some but not all words its ``kept`` text (binary) and
    removed word ``spans``."""
    return settled(docs.sparkSession, lambda: _remove_repeats(docs, length))


def _remove_repeats(docs: DataFrame, length: int) -> DataFrame:
    table = written(profile(docs, length))
    groups = (table.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= length)).groupBy("sha")
              .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.first("anchors").alias("anchors")))
    groups = written(groups)
    seen = groups.select(F.col("owner").alias("doc_id"), F.explode("anchors").alias("anchor"))
    shared = (seen.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
              .where("lo < hi").select("anchor"))
    marked = seen.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
    candidates = written(text_rows(docs).join(marked, "doc_id"))
    windows = _windows(candidates, length)
    first = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
                                                    ).where("first < last").select("anchor", "window", "first")
    # written, so that both sides of the join are exchanged and a window that
    # very many documents hold can be split
    first = written(first)
    late = windows.join(first, ["anchor", "window"]).where("first < doc_id")
    starts = late.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    cut = written(_cut(candidates.join(starts, "doc_id"), length).dropDuplicates(["doc_id", "sha"]))
    copies = groups.where("owner < last").select("sha", "owner")
    whole = F.coalesce(F.col("owner") < F.col("doc_id"), F.lit(False))
    return (table.select("doc_id", "n_words", "sha").join(copies, "sha", "left").join(cut, ["doc_id", "sha"], "left")
            .select("doc_id", "n_words",
                    F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(whole, F.lit(EMPTY_SHA)).when(F.col("n_removed").isNotNull(), F.sha2("kept", 256))
                     .otherwise(F.col("sha")).alias("kept_sha256"),
                    F.when(~whole, F.col("kept")).alias("kept"), F.when(~whole, F.col("spans")).alias("spans")))
