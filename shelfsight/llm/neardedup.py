"""MinHash near-duplicate groups by a multi-index Hamming join.

Words are the maximal runs outside ``\\x20\\x09-\\x0D`` with A-Z lower-cased.
A document's set holds its distinct ``shingle`` -word runs (a shorter
document is one shingle; a document without words has an empty set and is
linked with nothing). Two documents are linked when
``100 * |A & B| >= percent * |A | B|``, judged on the full sets.

Method
  1. Every document gets ``CHUNKS * SLOTS`` MinHash values cut to b = 16 bits;
     four slots make one 64-bit chunk. Equal sets are folded to their
     smallest doc_id first, so exact copies cost one row.
  2. Two signatures that differ in at most ``MAX_DISTANCE`` of the 40 slots
     differ in at most ``CHUNK_ERRORS`` = 1 slot of some chunk (pigeonhole:
     10 chunks with two errors each need 20). For every chunk the allowed
     error is enumerated by blanking one slot at a time: 40 keys a document,
     and every pair under the distance shares at least one key. A pair with
     similarity 0.75 shares none with probability 0.262 ** 10 = 1.5e-6.
  3. Candidates of a key are compared in a star: every member with the key's
     smallest document, on full sets. No bucket emits all its pairs.
  4. Stars whose members are then in different components may hold links past
     their centre. Their documents (and only they) get sharp keys: ``BANDS``
     picks of ``PICK`` out of ``WIDE`` further MinHash slots. Documents of
     similarity 0.75 share one but for a chance of some 1e-4, those of 0.45
     once in fifteen times. Sharp buckets are compared in stars first; what stays in
     different components of one sharp bucket is compared pair by pair where
     an exact bound from the star allows a link.
  5. Components come from alternating large-star / small-star rounds over
     tables in the checkpoint folder; later links join components, not
     documents. Only flags reach the driver.
Texts are read a second time for the sets of candidates: a bitmap of fixed
size (``FILTER_BITS``) of their ids, broadcast, leaves the others out without a
shuffle of texts. Ids that it lets through by chance are dropped by the joins.

Words and shingles are compared by 64-bit hashes (see ``wordhash``).

Defined results for odd input: NULL text is empty; every row is returned, and
rows that repeat a doc_id each get the component of their own set; a NULL
doc_id takes part in nothing (component_id NULL, kept true); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm import wordhash as wh
from shelfsight.llm.common import FILTER_BITS, settled, text_rows, with_ids_among, written

CHUNKS, SLOTS, CHUNK_ERRORS = 10, 4, 1
MAX_DISTANCE = CHUNKS * (CHUNK_ERRORS + 1) - 1
WIDE, PICK, BANDS = 512, 10, 200
ADDED_BITS = 1024
_CHUNK_COLUMNS = [f"c{i}" for i in range(CHUNKS)]
_BIT_COLUMNS = [f"b{i}" for i in range(ADDED_BITS // 64)]


def _sets(words: np.ndarray, bounds: np.ndarray, shingle: int):
    """Sorted distinct shingle hashes of every document of a batch."""
    runs = wh.window_hashes(words, shingle)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = int(b - a)
        if n >= shingle:
            yield np.unique(runs[a:b - shingle + 1])
        elif n:
            yield wh.window_hashes(words[a:b], n)
        else:
            yield np.zeros(0, np.uint64)


def _permutations(first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(first + 1, first + count + 1, dtype=np.uint64)
    return wh.mix(k * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1), wh.mix(k * np.uint64(0x8EBC6AF09C88C6E3))


def _minima(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    best = np.full(len(mul), np.uint64(0xFFFFFFFFFFFFFFFF))
    step = max(1, 81920 // len(mul))
    for i in range(0, len(s), step):
        np.minimum(best, (s[i:i + step, None] * mul + add).min(axis=0), out=best)
    return best


def _signature(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """CHUNKS 64-bit chunks of SLOTS 16-bit MinHash slots."""
    slots = wh.mix(_minima(s, mul, add)) & np.uint64(0xFFFF)
    shift = np.arange(SLOTS, dtype=np.uint64) * np.uint64(16)
    return np.bitwise_or.reduce(slots.reshape(CHUNKS, SLOTS) << shift, axis=1).view(np.int64)


def signatures(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, a 128-bit set fingerprint (f1, f2) and the chunks."""
    def run(it):
        mul, add = _permutations(0, CHUNKS * SLOTS)
        for batch in wh.batches(it):
            words, _, _, bounds = wh.hash_words(*wh.buffers(batch.column("text")), lower=True)
            size, finger, chunks = [], [], []
            for s in _sets(words, bounds, shingle):
                size.append(len(s))
                finger.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                chunks.append(_signature(s, mul, add))
            finger, chunks = np.array(finger), np.array(chunks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(finger[:, 0]), pa.array(finger[:, 1]),
                 *(pa.array(chunks[:, i]) for i in range(CHUNKS))],
                ["doc_id", "n_shingles", "f1", "f2", *_CHUNK_COLUMNS])
    return text_rows(docs).mapInArrow(
        run, "doc_id long, n_shingles long, f1 long, f2 long, " + ", ".join(f"{c} long" for c in _CHUNK_COLUMNS))


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and its full set as 64-bit hashes."""
    def run(it):
        for batch in wh.batches(it):
            words, _, _, bounds = wh.hash_words(*wh.buffers(batch.column("text")), lower=True)
            sets = list(_sets(words, bounds, shingle))
            values = np.concatenate(sets).view(np.int64)
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["doc_id", "shingles"])
    return text_rows(docs).mapInArrow(run, "doc_id long, shingles array<long>")


def _sets_of(docs: DataFrame, sig: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """The sets of the needed documents, rows that repeat one of them once."""
    again = sig.groupBy("doc_id", "f1", "f2").agg(F.count("*").alias("n")).where("n > 1").join(needed, "doc_id", "left_semi")
    rows = with_ids_among(docs.select("doc_id", "text"), needed, "doc_id", "_needed").where("_needed").drop("_needed")
    rows = with_ids_among(rows, again.select("doc_id").distinct(), "doc_id", "_again", FILTER_BITS >> 4)
    once = shingle_sets(rows.where("NOT _again"), shingle)
    more = shingle_sets(rows.where("_again").dropDuplicates(["doc_id", "text"]), shingle)
    return once.union(more)


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(key, id): for every chunk, one key per blanked slot."""
    keys = []
    for i, c in enumerate(_CHUNK_COLUMNS):
        for j in range(SLOTS):
            mask = ~(0xFFFF << (16 * j)) & 0xFFFFFFFFFFFFFFFF
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.xxhash64(F.lit(i * SLOTS + j), F.col(c).bitwiseAND(F.lit(signed).cast("long"))))
    return nodes.select("id", F.explode(F.array(*keys)).alias("key"))


def overlaps(pairs: DataFrame, sets: DataFrame, added: bool = False) -> DataFrame:
    """(u, v, i, n, m): common shingles and both sizes of every pair; with
    ``added`` also the shingles of u that v lacks."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    more = [F.array_except("su", "sv").alias("added")] if added else []
    return pairs.join(a, "u").join(b, "v").select(
        "u", "v", F.size(F.array_intersect("su", "sv")).cast("long").alias("i"),
        F.size("su").cast("long").alias("n"), F.size("sv").cast("long").alias("m"), *more)


def _linked(percent: int):
    return 100 * F.col("i") >= percent * (F.col("n") + F.col("m") - F.col("i"))


def sharp_keys(sets: DataFrame) -> DataFrame:
    """(id, key): BANDS keys of every set, each of PICK of WIDE MinHash slots."""
    def run(it):
        mul, add = _permutations(CHUNKS * SLOTS, WIDE)
        rng = np.random.default_rng(WIDE)
        picks = np.stack([rng.choice(WIDE, PICK, replace=False) for _ in range(BANDS)])
        for batch in it:
            ids, keys = [], []
            for d, shingles in zip(batch.column("doc_id").to_pylist(), batch.column("shingles"), strict=True):
                slots = _minima(np.asarray(shingles.values).view(np.uint64), mul, add)[picks]
                key = np.arange(BANDS, dtype=np.uint64)
                for j in range(PICK):
                    key = wh.mix(key * np.uint64(0xD6E8FEB86659FD93) + slots[:, j])
                ids.append(np.full(BANDS, d, np.int64))
                keys.append(key.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], ["id", "key"])
    return sets.mapInArrow(run, "id long, key long")


def addition_bits(judged: DataFrame) -> DataFrame:
    """(id, p, i, n, rest, b0, b1, ...) of the judged pairs (u, v): a bitmap of
    the shingles of u that v lacks, and how many of them share a bit with another.
    One row a pair, whatever the number of shingles."""
    def run(it):
        for batch in it:
            marks, rest = [], []
            for added in batch.column("added"):
                values = np.asarray(added.values).view(np.uint64) % np.uint64(ADDED_BITS)
                mark = np.zeros(ADDED_BITS, np.uint8)
                mark[values.astype(np.int64)] = 1
                marks.append(np.packbits(mark).view(np.int64))
                rest.append(len(values) - int(mark.sum()))
            if rest:
                bits = np.array(marks)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("id", "p", "i", "n")), pa.array(rest, pa.int64()),
                     *(pa.array(bits[:, k]) for k in range(len(_BIT_COLUMNS)))],
                    ["id", "p", "i", "n", "rest", *_BIT_COLUMNS])
    return judged.select(F.col("u").alias("id"), F.col("v").alias("p"), "i", "n", "added").mapInArrow(
        run, ", ".join(f"{c} long" for c in ("id", "p", "i", "n", "rest", *_BIT_COLUMNS)))


def mixed_stars(stars: DataFrame, label: DataFrame) -> DataFrame:
    """(id): documents of stars that hold more than one component."""
    star = stars.select(F.col("v").alias("c"), F.col("u").alias("id")).union(
        stars.select("v", F.col("v")).distinct())
    star = star.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = star.groupBy("c").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("c")
    # written, so that a star of very many documents can be split in the join
    return star.join(written(mixed), "c").select("id").distinct()


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` after further links. Only the components they touch are
    joined; documents without a link so far are their own component."""
    def named(end: str) -> DataFrame:
        return label.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    ends = links.join(named("u"), "u", "left").join(named("v"), "v", "left").select(
        "u", "v", F.coalesce("u_label", "u").alias("lu"), F.coalesce("v_label", "v").alias("lv"))
    ends = written(ends)
    joined = components(ends.select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    old = label.union(ends.select("u", "lu")).union(ends.select("v", "lv")).distinct()
    new = joined.select(F.col("id").alias("label"), F.col("label").alias("least"))
    return written(old.join(new, "label", "left").select("id", F.coalesce("least", "label").alias("label")))


def sharp_links(sets: DataFrame, stars: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """``label`` after the links past the centres of mixed stars.

    Documents x, y of a sharp bucket with the smallest document p have at most
    ``min(i_x, i_y) + |bits_x & bits_y| + min(rest_x, rest_y)`` common shingles:
    i are those shared with p; of the others, every common one has its bit in
    both bitmaps, and no more of them share a bit than of all that x, or y, has.
    Pairs whose sizes need more are not compared; the bound is exact."""
    ids = written(mixed_stars(stars, label))
    if not ids.limit(1).count():
        return label
    keys = written(sharp_keys(sets.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")).distinct())

    def named(members: DataFrame, label: DataFrame) -> DataFrame:
        return members.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # buckets with several components
    labelled = named(keys, label)
    mixed = labelled.groupBy("key").agg(F.min("id").alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")
                                        ).where("lo < hi").select("key", "p")
    members = written(keys.join(written(mixed), "key"))
    pairs = members.where("id > p").select(F.col("id").alias("u"), F.col("p").alias("v")).distinct()
    judged = written(overlaps(pairs, sets, added=True))
    links = judged.where(_linked(percent)).select("u", "v")
    if links.limit(1).count():
        label = merged(label, links)

    # what is still apart within one sharp bucket
    known = written(addition_bits(judged))
    members = written(named(members.join(known, ["id", "p"]), label))

    def side(end: str) -> DataFrame:
        return members.select("key", F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("label", "i", "n", "rest", *_BIT_COLUMNS)))
    common = sum((F.bit_count(F.col(f"b{k}_u").bitwiseAND(F.col(f"b{k}_v"))) for k in range(len(_BIT_COLUMNS))), F.lit(0))
    bound = F.least("i_u", "i_v") + common + F.least("rest_u", "rest_v")
    close = side("u").join(side("v"), "key").where(
        (F.col("u") > F.col("v")) & (F.col("label_u") != F.col("label_v"))
        & ((100 + percent) * bound >= percent * (F.col("n_u") + F.col("n_v"))))
    judged = written(overlaps(close.select("u", "v").distinct(), sets).where(_linked(percent)).select("u", "v"))
    return merged(label, judged) if judged.limit(1).count() else label


def components(edges: DataFrame) -> DataFrame:
    """(id, label): smallest id of the component of every id with an edge.

    Alternating large-star / small-star rounds. Minima are pre-aggregated
    before each shuffle; the join that hands them back is a sort-merge join
    that AQE can split at a hot centre."""
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .where("u <> v").distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every u has one v and no v is a u (each component a star)."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
        e.select("v", F.lit(0), F.lit(1)))
    bad = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where(
        "out > 1 OR out = 1 AND in = 1")
    return not bad.limit(1).count()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    return settled(docs.sparkSession, lambda: _near_duplicates(docs, shingle, percent))


def _near_duplicates(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    sig = written(signatures(docs, shingle))
    nodes = (sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2")
             .agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"),
                  *(F.max(c).alias(c) for c in _CHUNK_COLUMNS)))
    nodes = written(nodes)

    keys = bucket_keys(nodes)
    shared = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("c")).where("c > 1")
    # written, so that both sides of the join are exchanged and a hot key can
    # be split
    shared = written(shared)
    star = written(keys.join(shared.select("key", "pivot"), "key").where("id <> pivot")
                   .groupBy(F.col("id").alias("u"), F.col("pivot").alias("v"))
                   .agg(F.count("*").alias("n_keys")).select("u", "v"))

    needed = written(star.select(F.col("u").alias("doc_id")).union(star.select(F.col("v").alias("doc_id"))).distinct())
    sets = written(_sets_of(docs, sig, needed, shingle))
    stars = written(overlaps(star, sets))
    label = written(components(stars.where(_linked(percent)).select("u", "v")))
    label = sharp_links(sets, stars, label, percent)

    named = nodes.select("f1", "f2", "id", "copies").join(label, "id", "left").where(
        "copies > 1 OR label IS NOT NULL").select("f1", "f2", F.coalesce("label", "id").alias("component"))
    return (sig.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.least(F.coalesce("component", "doc_id"), "doc_id"))
                     .otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
