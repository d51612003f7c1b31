"""Token output in training order: fixed-stride binary shards.

Every document is tokenised, ended by the end token and cut into sequences of
``seq_len`` ids (the last one padded). A keyed Feistel permutation over the
smallest even-bit domain that holds the number of sequences, walked until it
falls inside, gives each sequence a global slot 0..N-1: a shuffled training
order that needs no random numbers, no sort key and no driver table. Slots are
range-partitioned into shards of ``per_shard`` records; a record is a fixed
number of bytes, so slot s is found at byte
``(s % per_shard) * stride`` of shard ``s // per_shard`` and reading resumes
anywhere without an index.

Record (little endian): doc_id int64, number in the document int32, ids used
int32, ``seq_len`` ids uint16, one byte ``\\n`` (the separator that Spark's
text writer puts after every record, counted in the stride).

Sequence numbers before the permutation follow the input: number of the scan
partition, then row order. Pass 1 counts sequences per partition (one row per
partition goes to the driver), pass 2 writes. Both read the same scan; a task
of pass 2 that does not find the count of pass 1 fails, so an input whose
order is not fixed cannot give wrong slots (give a written table).

Defined results for odd input: NULL text is empty; an empty text gives one
sequence holding the end token only; a NULL doc_id is written as -1; repeated
rows are each written; an empty table gives no shards and an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm import wordhash as wh
from shelfsight.llm.common import text_rows

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts text before byte pairs are merged.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Entries of a worker's table of known words; a full table is started anew.
MAX_KNOWN = 1_000_000
SEQ_LEN, PER_SHARD, KEY, ROUNDS = 256, 8192, 20240229, 6
HEADER = 16


def stride(seq_len: int) -> int:
    return HEADER + 2 * seq_len + 1


# -------------------------------------------------------------- permutation
def half_bits(n: int) -> int:
    """Bits of one half of the smallest even-bit domain with n values."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _round(right: np.ndarray, key: int, r: int, mask: np.uint64) -> np.ndarray:
    return wh.mix(right + wh.mix(np.array([key * 64 + r], np.uint64))) & mask


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of sequence numbers: a bijection of 0..n-1."""
    bits = np.uint64(half_bits(n))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x = index.astype(np.uint64)
    walk = np.arange(len(x))
    while len(walk):
        left, right = x[walk] >> bits, x[walk] & mask
        for r in range(rounds):
            left, right = right, left ^ _round(right, key, r, mask)
        x[walk] = (left << bits) | right
        walk = walk[x[walk] >= np.uint64(n)]
    return x.astype(np.int64)


# ------------------------------------------------------------------- tokens
class Tokens:
    """A byte-pair vocabulary (lines: base64 of the bytes, rank) whose ids
    and one end token fit 16 bits.

    A space before a non-space starts a new piece of the cutting pattern, so
    a text is encoded word by word. The words of a slice are told apart by
    64-bit hashes and each distinct word is encoded once: the new ones of a
    slice together, as one text, whose ids are cut apart where an id begins
    with a space. A bounded sorted table keeps words over slices, and the ids
    of a document are laid out by index arithmetic. Texts in which white space
    meets a space, or that end with one, are encoded as a whole: there a cut
    could fall inside a piece."""

    _FIRST = np.uint64(0x2545F4914F6CDD1D)  # marks a word without a space before it
    # What may end or begin with white space: ASCII, or a byte of a longer character.
    _MAY_BE_SPACE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3])
    _MAY_END_SPACE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0xC0)])

    def __init__(self, vocabulary: bytes):
        import tiktoken
        ranks = {base64.b64decode(w): int(r) for w, r in map(bytes.split, vocabulary.splitlines())}
        self.end = max(ranks.values()) + 1
        if self.end >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._opens = np.zeros(self.end, bool)  # ids that begin with a space
        self._opens[[r for w, r in ranks.items() if w.startswith(b" ")]] = True
        self._forget()

    def _forget(self) -> None:
        """The table of known words: sorted hashes, where the ids of each
        begin in ``flat``, and how many they are."""
        self.known, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.model.encode_ordinary(text.decode("utf-8", "replace")), np.uint16)

    def _encode(self, words: list[bytes], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their number per word. Words marked ``alone``
        are texts of their own, each other one stands after a space."""
        size = np.zeros(len(words), np.int64)
        together = b"".join(b" " + w for w, a in zip(words, alone.tolist(), strict=True) if not a)
        joint = self.whole(together)
        at = np.flatnonzero(self._opens[joint])
        if len(at) != len(words) - alone.sum():
            raise ValueError("the vocabulary does not begin a piece at every space")
        size[~alone] = np.diff(np.append(at, len(joint)))
        singles = [self.whole(words[i]) for i in np.flatnonzero(alone)]
        size[alone] = list(map(len, singles))
        flat = np.empty(size.sum(), np.uint16)
        single = np.repeat(alone, size)
        flat[~single] = joint
        if singles:
            flat[single] = np.concatenate(singles)
        return flat, size

    def _learn(self, buf, hashes, starts, ends, first) -> None:
        """Add words that are not in the table."""
        odd = ~first & self._MAY_BE_SPACE[buf[starts]]
        raw = buf.tobytes()
        words = [(b" " if o else b"") + raw[a:b] for a, b, o in
                 zip(starts.tolist(), ends.tolist(), odd.tolist(), strict=True)]
        flat, size = self._encode(words, first | odd)
        begin = np.cumsum(size) - size + len(self.flat)
        known = np.append(self.known, hashes)
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.begin, self.size = np.append(self.begin, begin)[order], np.append(self.size, size)[order]
        self.flat = np.append(self.flat, flat)

    def _places(self, buf, hashes, starts, ends, first):
        """Where the ids of every word begin in ``flat``, and their number."""
        which, distinct = pd.factorize(hashes)
        if len(self.known) > MAX_KNOWN:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        inside = at < len(self.known)
        inside[inside] = self.known[at[inside]] == distinct[inside]
        if not inside.all():
            seen = np.empty(len(distinct), np.int64)
            seen[which[::-1]] = np.arange(len(which))[::-1]
            new = seen[~inside]
            self._learn(buf, distinct[~inside], starts[new], ends[new], first[new])
            at = np.searchsorted(self.known, distinct)
        return self.begin[at][which], self.size[at][which]

    def _uncut(self, buf, offsets) -> list[int]:
        """Texts that cannot be taken word by word."""
        blank = np.flatnonzero(buf == 0x20)
        before, after = buf[np.maximum(blank - 1, 0)], buf[np.minimum(blank + 1, len(buf) - 1)]
        doc = np.searchsorted(offsets, blank, side="right") - 1
        last = blank + 1 == offsets[doc + 1]
        odd = (after == 0x20) | (self._MAY_END_SPACE[before] & self._MAY_BE_SPACE[after])
        return np.unique(doc[last | odd]).tolist()

    def slice(self, column: pa.Array, count_only: bool = False):
        """Per document of a slice its ids and the end token, or their number."""
        buf, offsets = wh.buffers(column)
        hashes, starts, ends, bounds = wh.hash_words(buf, offsets, lower=False, gap=wh.BLANK)
        first = np.zeros(len(buf) + 1, bool)
        first[offsets] = True
        first = first[starts]
        begin, size = self._places(buf, hashes ^ np.where(first, self._FIRST, np.uint64(0)), starts, ends, first)
        word_end = np.concatenate([[0], np.cumsum(size)])
        whole = {i: self.whole(column[i].as_py()) for i in self._uncut(buf, offsets)}
        if count_only:
            n = word_end[bounds[1:]] - word_end[bounds[:-1]]
            return [len(whole[i]) + 1 if i in whole else int(x) + 1 for i, x in enumerate(n)]
        ids = self.flat[np.arange(word_end[-1]) + np.repeat(begin - word_end[:-1], size)]
        end = np.uint16(self.end)
        return [np.append(whole[i] if i in whole else ids[word_end[a]:word_end[b]], end)
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


@lru_cache(maxsize=1)
def _tokens(vocabulary: bytes) -> Tokens:
    """One table per Python worker, kept over its tasks."""
    return Tokens(vocabulary)


def _encoded(it, vocabulary: bytes):
    """(doc_ids, id arrays, pad) of slices of a partition, in row order."""
    tokens = _tokens(vocabulary)
    for batch in wh.batches(it, 8 << 20):
        ids = batch.column("doc_id").to_pylist()
        yield [-1 if d is None else d for d in ids], tokens.slice(batch.column("text")), tokens.end


def _count(rows: DataFrame, model, seq_len: int) -> dict[int, int]:
    """Sequences per scan partition."""
    def run(it):
        tokens = _tokens(model.value)
        n = sum(-(-x // seq_len) for batch in wh.batches(it, 8 << 20)
                for x in tokens.slice(batch.column("text"), count_only=True))
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n]})
    return {r["part"]: r["n"] for r in rows.mapInArrow(run, "part long, n long").collect()}


def sequences(docs: DataFrame, seq_len: int = SEQ_LEN, key: int = KEY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(slot, record) of every sequence; records as described above without
    the final separator."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    rows = text_rows(docs)
    counts = _count(rows, model, seq_len)
    parts = sorted(counts)
    starts = dict(zip(parts, itertools.accumulate([0, *(counts[p] for p in parts)]), strict=False))
    total = sum(counts.values())
    table = spark.sparkContext.broadcast((counts, starts))

    def run(it):
        part = TaskContext.get().partitionId()
        expected, first = table.value[0].get(part, 0), table.value[1].get(part, 0)
        at = 0
        for doc_ids, ids, pad in _encoded(it, model.value):
            n = [-(-len(x) // seq_len) for x in ids]
            size = sum(n)
            record = np.zeros(size, np.dtype([("doc", "<i8"), ("no", "<i4"), ("used", "<i4"), ("ids", "<u2", (seq_len,))]))
            flat = np.full((size, seq_len), pad, np.uint16)
            row = 0
            for d, x, k in zip(doc_ids, ids, n, strict=True):
                flat[row:row + k].reshape(-1)[:len(x)] = x
                record["doc"][row:row + k] = d
                record["no"][row:row + k] = np.arange(k)
                record["used"][row:row + k] = seq_len
                record["used"][row + k - 1] = len(x) - (k - 1) * seq_len
                row += k
            record["ids"] = flat
            if at + size > expected:
                break
            slot = permute(np.arange(first + at, first + at + size), total, key)
            at += size
            width = record.dtype.itemsize
            offsets = pa.py_buffer((np.arange(size + 1) * width).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.BinaryArray.from_buffers(pa.binary(), size, [None, offsets, pa.py_buffer(record.tobytes())])],
                ["slot", "record"])
        if at != expected:
            raise RuntimeError("the input changed its order between two passes; give a written table")
    return rows.mapInArrow(run, "slot long, record binary")


def write_shards(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = KEY,
                 tokenizer: str = TOKENIZER) -> None:
    """Write the shards ``path/shard=<k>/part-*``, one file each, records in
    slot order. Spark's commit protocol makes a lost task's output vanish."""
    seq = sequences(docs, seq_len, key, tokenizer).withColumn("shard", F.expr(f"slot div {per_shard}"))
    (seq.repartition("shard").sortWithinPartitions("shard", "slot")
     .select("shard", F.col("record").cast("string").alias("value"))
     .write.mode("overwrite").partitionBy("shard").text(path))


def read_shards(spark: SparkSession, path: str, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD,
                from_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, seq_no, n_tokens, ids_sha256, ids)
    of the records from ``from_slot`` on; earlier shards are not opened."""
    size = stride(seq_len)
    schema = ("slot long, shard long, byte_offset long, doc_id long, seq_no long, n_tokens long, ids_sha256 string, "
              "ids array<int>")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if "shard" not in files.columns:  # no shards: there were no sequences
        return spark.createDataFrame([], schema)
    files = files.where(F.col("shard") >= from_slot // per_shard).select(F.col("shard").cast("long"), "content")

    def run(it):
        kind = np.dtype([("doc", "<i8"), ("no", "<i4"), ("used", "<i4"), ("ids", "<u2", (seq_len,)), ("sep", "u1")])
        for batch in it:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                if len(raw) % size:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                rec = np.frombuffer(raw, kind)
                slot = shard * per_shard + np.arange(len(rec))
                rec, slot = rec[slot >= from_slot], slot[slot >= from_slot]
                for a in range(0, len(rec), 2048):
                    r, s = rec[a:a + 2048], slot[a:a + 2048]
                    ids = [x[:n] for x, n in zip(r["ids"], r["used"].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s), pa.array(s // per_shard), pa.array((s % per_shard) * size),
                         pa.array(r["doc"].copy()), pa.array(r["no"].astype(np.int64)),
                         pa.array(r["used"].astype(np.int64)),
                         pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                         pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))],
                        ["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "ids_sha256", "ids"])
    return files.mapInArrow(run, schema)
