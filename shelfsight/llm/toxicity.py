"""Toxic spans by a linear-chain conditional random field.

Tokens are the runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased. A token's features are its own word and the prefixes of 4, 5 and
6 bytes, and the words before and after it, each hashed to ``2 ** BITS``
weights; two labels (clean, toxic) are linked by transition weights along the
whole document.

Fit (on a bounded sample of labelled rows: ``FIT_DOCS`` different texts of
either class of at most ``FIT_CHARS`` characters, the first by a hash of the
text; everything else covers all rows)
  1. Labels are given for documents only. A word or prefix is a *mark* when it
     comes in at least ``MARK_LEAST`` different contexts (word before, word
     after) of toxic documents, ``MARK_RATIO`` times as often a word as in
     clean ones. Counting contexts, not places, makes copies of a document
     count once. Tokens of toxic documents with a mark are labelled toxic, all
     others clean.
  2. The field's weights follow the gradient of the log-likelihood of these
     labels (forward-backward expectations, AdaGrad over batches of chunks).
  3. A logistic regression on the expected toxic tokens of a document (their
     share and their number) gives the document score, with the class shares
     of all labelled rows.

Score: forward-backward marginals of every token of every whole text. The
chain is cut into blocks of ``BLOCK`` tokens whose 2 x 2 transfer matrices are
multiplied along the document, so long texts need few steps and the marginals
are those of the uncut chain. Stretches of tokens with a marginal of a half or
more are the offending spans (code points).

Defined results for odd input: NULL text is empty and gets the score of a text
without toxic tokens; rows are scored one by one, whatever their doc_id;
labels that are NULL or of no document are ignored, several labels of a
document count as toxic if one is; without labels of both classes all scores
are the share of toxic labels (0 if none); empty tables give an empty result;
other columns, lang and source among them, are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm import wordhash as wh
from shelfsight.llm.common import text_column, text_rows

BITS, BLOCK = 16, 64
FIT_DOCS, FIT_CHARS = 1500, 10_000
MARK_LEAST, MARK_RATIO = 6, 6
# At least so many epochs and steps over batches of chunks.
EPOCHS, STEPS, RATE, RIDGE, BATCH, SEED = 3, 200, 0.5, 1e-6, 256, 13
_OWN, _TEMPLATES = 4, 6
_PREFIXES = (4, 5, 6)

_GAP = np.arange(256) < 0x80
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Model:
    weights: np.ndarray  # per template and hashed feature
    bias: float
    moves: np.ndarray    # log weight of label -> label
    document: np.ndarray  # of the document regression

    def emissions(self, features: np.ndarray) -> np.ndarray:
        at = (features >> np.uint64(64 - BITS)).astype(np.int64)
        out = np.full(features.shape[1], self.bias, np.float32)
        for w, i in zip(self.weights, at, strict=True):
            out += w[i]
        return out


def _features(column: pa.Array):
    """(features by template, starts, ends, bounds, bytes, offsets)."""
    buf, offsets = wh.buffers(column)
    words, starts, ends, bounds = wh.hash_words(buf, offsets, lower=True, gap=_GAP)
    low = np.concatenate([_LOWER[buf], np.zeros(max(_PREFIXES), np.uint8)])
    size = ends - starts
    prefix, rows = np.zeros(len(words), np.uint64), [words]
    for j in range(max(_PREFIXES)):
        prefix |= np.where(size > j, low[starts + j], 0).astype(np.uint64) << np.uint64(8 * j)
        if j + 1 in _PREFIXES:
            rows.append(prefix.copy())
    before, after = np.zeros_like(words), np.zeros_like(words)
    before[1:], after[:-1] = words[:-1], words[1:]
    some = bounds[1:] > bounds[:-1]
    before[bounds[:-1][some]] = 0
    after[bounds[1:][some] - 1] = 0
    rows += [before, after]
    salt = wh.mix(np.arange(1, _TEMPLATES + 1, dtype=np.uint64))
    return np.stack([wh.mix(r ^ s) for r, s in zip(rows, salt, strict=True)]), starts, ends, bounds, buf, offsets


def _blocks(bounds: np.ndarray):
    """(start, length, place in the document) of the blocks, by document."""
    n = np.diff(bounds)
    count = -(-n // BLOCK)
    doc = np.repeat(np.arange(len(n)), count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][doc] + BLOCK * place
    return start, np.minimum(BLOCK, bounds[1:][doc] - start), place, doc


def _inside(psi, move, start, size, enter, leave, pairs: bool = False):
    """Marginals of all tokens of the blocks (sorted by falling size), given
    the weight of either label before and after each block; and the expected
    label pairs."""
    active = np.searchsorted(-size, -np.arange(1, BLOCK + 1), side="right")
    f0, f1 = enter[:, 0].copy(), enter[:, 1].copy()
    front = np.zeros((2, BLOCK, len(start)), np.float64)
    for t in range(BLOCK):
        m = active[t]
        if not m:
            break
        w = psi[start[:m] + t]
        a0 = f0[:m] * move[0, 0] + f1[:m] * move[1, 0]
        a1 = (f0[:m] * move[0, 1] + f1[:m] * move[1, 1]) * w
        total = a0 + a1
        f0[:m], f1[:m] = a0 / total, a1 / total
        front[0, t, :m], front[1, t, :m] = f0[:m], f1[:m]
    b0, b1 = leave[:, 0].copy(), leave[:, 1].copy()
    marginal, expected = np.zeros(len(psi), np.float64), np.zeros((2, 2))
    for t in range(BLOCK - 1, -1, -1):
        m = active[t]
        if not m:
            continue
        x0, x1 = front[0, t, :m] * b0[:m], front[1, t, :m] * b1[:m]
        marginal[start[:m] + t] = x1 / (x0 + x1)
        w = psi[start[:m] + t]
        y0, y1 = b0[:m], w * b1[:m]
        if pairs:
            p0, p1 = (front[0, t - 1, :m], front[1, t - 1, :m]) if t else (enter[:m, 0], enter[:m, 1])
            both = np.array([[p0 * move[0, 0] * y0, p0 * move[0, 1] * y1], [p1 * move[1, 0] * y0, p1 * move[1, 1] * y1]])
            expected += (both / both.sum(axis=(0, 1))).sum(axis=2)
        c0, c1 = move[0, 0] * y0 + move[0, 1] * y1, move[1, 0] * y0 + move[1, 1] * y1
        total = c0 + c1
        b0[:m], b1[:m] = c0 / total, c1 / total
    return marginal, expected


def _marginals(emission: np.ndarray, moves: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Probability of the toxic label of every token; a document begins after
    a clean token."""
    psi, move = np.exp(np.clip(emission, -30, 30)).astype(np.float64), np.exp(moves)
    start, size, place, doc = _blocks(bounds)
    if not len(start):
        return np.zeros(len(psi))
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(1, BLOCK + 1), side="right")
    matrix = np.tile(np.eye(2), (len(start), 1, 1))
    for t in range(BLOCK):
        m = active[t]
        if not m:
            break
        step = matrix[:m] @ move
        step[:, :, 1] *= psi[start[order[:m]] + t][:, None]
        matrix[:m] = step / step.sum(axis=(1, 2))[:, None, None]
    by_block = np.empty_like(matrix)
    by_block[order] = matrix
    enter, leave = np.zeros((len(start), 2)), np.ones((len(start), 2))
    enter[:, 0] = 1
    first = np.flatnonzero(place == 0)
    count = np.bincount(doc, minlength=1)[doc[first]]
    first, count = first[np.argsort(-count, kind="stable")], -np.sort(-count)
    for k in range(int(count[0]) - 1):
        at = first[:np.searchsorted(-count, -(k + 1))] + k
        v = np.einsum("ni,nij->nj", enter[at], by_block[at])
        enter[at + 1] = v / v.sum(axis=1)[:, None]
    for k in range(int(count[0]) - 2, -1, -1):
        at = first[:np.searchsorted(-count, -(k + 1))] + k
        u = np.einsum("nij,nj->ni", by_block[at + 1], leave[at + 1])
        leave[at] = u / u.sum(axis=1)[:, None]
    return _inside(psi, move, start[order], size[order], enter[order], leave[order])[0]


def _marks(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each token has a mark among its own features."""
    context = wh.mix(features[_OWN] + wh.mix(features[_OWN + 1]))
    out = np.zeros(len(toxic), bool)
    total = np.array([np.count_nonzero(~toxic), np.count_nonzero(toxic)], float)
    for own in features[:_OWN]:
        seen = []
        for label in (False, True):
            some = toxic == label
            key = np.lexsort((context[some], own[some]))
            a, b = own[some][key], context[some][key]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            seen.append(np.unique(a[new], return_counts=True))
        (clean, n0), (names, n1) = seen
        at = np.minimum(np.searchsorted(clean, names), max(len(clean) - 1, 0))
        rest = np.where(clean[at] == names, n0[at], 0) if len(clean) else np.zeros(len(names))
        marks = names[(n1 >= MARK_LEAST) & (n1 / total[1] >= MARK_RATIO * (rest + 0.5) / total[0])]
        out |= np.isin(own, marks)
    return out


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _document(marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Inputs of the document regression."""
    total = np.concatenate([[0.0], np.cumsum(marginal)])
    toxic, n = total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds)
    return np.stack([np.ones(len(n)), np.log(0.002 + toxic / (n + 10)), np.log1p(toxic)], axis=1)


def train(texts: list[bytes], labels: np.ndarray, share: float) -> Model:
    """The model of the sample; ``share`` of all labels are toxic."""
    features, _, _, bounds, _, _ = _features(pa.array(texts, pa.binary()))
    toxic = np.repeat(labels.astype(bool), np.diff(bounds))
    y = _marks(features, toxic) & toxic
    at = (features >> np.uint64(64 - BITS)).astype(np.int64)
    start, size, _, _ = _blocks(bounds)
    rate = (y.mean() if len(y) else 0.0) + 1e-4
    bias, moves = float(np.log(rate)), np.zeros((2, 2))
    weights = np.zeros((_TEMPLATES, 1 << BITS))
    sums, sum_bias, sum_moves = np.full(weights.shape, 1e-2), 1e-2, np.full((2, 2), 1e-2)
    rng = np.random.default_rng(SEED)
    batches = max(1, len(start) // BATCH)
    for _ in range(max(EPOCHS, -(-STEPS // batches))):
        for some in np.array_split(rng.permutation(len(start)), batches):
            if not len(some):
                continue
            some = some[np.argsort(-size[some], kind="stable")]
            n = size[some]
            here = np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            local = np.cumsum(n) - n
            columns = at[:, here]
            score = bias + sum(weights[k][columns[k]] for k in range(_TEMPLATES))
            enter = np.tile([1.0, 0.0], (len(some), 1))
            p, pairs = _inside(np.exp(np.clip(score, -30, 30)), np.exp(moves), local, n, enter, np.ones((len(some), 2)), True)
            truth = y[here]
            last = np.concatenate([[False], truth[:-1]])
            last[local] = False
            seen = np.bincount(2 * last + truth, minlength=4).reshape(2, 2)
            gap, scale = truth - p, 1 / len(some)
            for k in range(_TEMPLATES):
                g = scale * np.bincount(columns[k], gap, 1 << BITS) - RIDGE * weights[k]
                sums[k] += g * g
                weights[k] += RATE * g / np.sqrt(sums[k])
            g = scale * gap.sum()
            sum_bias += g * g
            bias += RATE * g / np.sqrt(sum_bias)
            g = scale * (seen - pairs)
            sum_moves += g * g
            moves = moves + RATE * g / np.sqrt(sum_moves)
    model = Model(weights.astype(np.float32), bias, moves, np.zeros(3))
    x = _document(_marginals(model.emissions(features), moves, bounds), bounds)
    w = _regression(x, labels.astype(float))
    mean = labels.mean()
    w[0] += np.log(share / (1 - share)) - np.log(mean / (1 - mean))
    model.document = w
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the documents that have a row (doc_id, toxic) in ``labels``."""
    known = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg((F.max(F.col("toxic").cast("int")) > 0).alias("toxic")))
    rows = docs.select("doc_id", text_column().alias("text"))
    texts = rows.select("doc_id", F.xxhash64("text").alias("key"), F.length("text").alias("n")).join(known, "doc_id")
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = shares.get(False, 0), shares.get(True, 0)
    share = n1 / (n0 + n1) if n1 else 0.0
    none = Model(np.zeros((_TEMPLATES, 1 << BITS), np.float32), -30.0, np.zeros((2, 2)), np.array([-np.inf, 0.0, 0.0]))
    if share:
        none.document[0] = np.log(share) - np.log1p(-share) if share < 1 else np.inf
    if share in (0, 1):
        return none
    picked = None
    for label in (False, True):
        one = (texts.where((F.col("toxic") == label) & (F.col("n") <= FIT_CHARS)).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
               .orderBy(F.xxhash64(F.lit(SEED), "key"), "key").limit(FIT_DOCS).select("doc_id", "key", F.lit(label).alias("toxic")))
        picked = one if picked is None else picked.union(one)
    sample = {}
    for r in rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "key"]).select("key", "text", "toxic").collect():
        sample[r["key"], r["toxic"]] = r["text"]
    keys = sorted(sample)
    labelled = np.array([k[1] for k in keys])
    if not len(keys) or labelled.all() or not labelled.any():
        return none
    return train([sample[k].encode() for k in keys], labelled, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_tokens and spans (start, end, p: the largest marginal)
    of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(it):
        model = shared.value
        for batch in wh.batches(it, 4 << 20):
            features, starts, ends, bounds, buf, offsets = _features(batch.column("text"))
            p = _marginals(model.emissions(features), model.moves, bounds)
            z = _document(p, bounds) @ model.document if np.isfinite(model.document[0]) else np.full(batch.num_rows, model.document[0])
            with np.errstate(over="ignore"):
                scores = 1 / (1 + np.exp(-z))
            spans = [[] for _ in range(batch.num_rows)]
            hit = np.flatnonzero(p >= 0.5)
            if len(hit):
                points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                doc = np.searchsorted(bounds, hit, side="right") - 1
                new = np.ones(len(hit), bool)
                new[1:] = (np.diff(hit) > 1) | (np.diff(doc) > 0)
                at, to = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hit)) - 1
                base = points[offsets[doc[at]]]
                high = np.maximum.reduceat(p[hit], at)
                for d, a, b, x in zip(doc[at].tolist(), (points[starts[hit[at]]] - base).tolist(),
                                      (points[ends[hit[to]]] - base).tolist(), high.tolist(), strict=True):
                    spans[d].append({"start": a, "end": b, "p": x})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array(np.diff(bounds), pa.int64()),
                 pa.array(spans, kind)], ["doc_id", "score", "n_tokens", "spans"])
    return text_rows(docs).mapInArrow(
        run, "doc_id long, score double, n_tokens long, spans array<struct<start: long, end: long, p: double>>")
