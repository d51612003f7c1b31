"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from shelfsight.llm import periodic, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, n_words int, w int, a int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_runs(words, least=12):
    """(start, length, period); the smallest period of a stretch is met first."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        equal = np.array([x == y for x, y in zip(words, words[q:])])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(int), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b + q - a >= max(least, 2 * q):
                found.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_row(doc_id, text):
    words = planted(doc_id, words_of(text))
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k = rng.choice([1, 2, 3, 5, 50])
            w = [rng.randrange(k) for _ in range(rng.randint(0, 80))]
            if w and rng.random() < 0.6:
                a, p = rng.randrange(len(w)), rng.randint(1, max(1, len(w) // 3))
                w = [w[i] if i < a else w[min(a + (i - a) % p, len(w) - 1)] for i in range(len(w) + rng.randint(0, 60))]
            texts.append(w)
        least = rng.choice([12, 12, 12, 2, 4, 7])
        start, end, period = periodic.runs_of(np.array([x for w in texts for x in w], np.int64),
                                              np.repeat(np.arange(len(texts)), list(map(len, texts))), least)
        want, at = [], 0
        for w in texts:
            want += [(s + at, s + at + n, q) for s, n, q in plain_runs(w, least)]
            at += len(w)
        assert sorted(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)) == sorted(want)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    line = " ".join(rng.choice("alpha beta gamma delta river stone".split()) for _ in range(40))
    out = [(None, None), (None, "a b " * 20), (1, ""), (2, " \n\t"), (3, "x " * 11), (4, "x " * 12), (5, "x\n" * 500),
           (6, "a b c " * 4), (6, "a b c " * 4), (7, "a b c d e f g " * 2), (8, line + " " + line), (9, (line + "\n") * 7 + "end"),
           (10, "a a a a a a b " * 5), (11, "é\x0bé\x0cé " * 9), (12, line + " cut " + line), (13, "a\x85a " * 30),
           (14, " ".join(f"w{i % 3000}" for i in range(9000)))]
    # ids whose texts are made to repeat
    repeat = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    out += [(i, " ".join(str(rng.randrange(40)) for _ in range(rng.randint(1, 300)))) for i in repeat]
    return out + [(i, "") for i in repeat[:3]]


def test_query_equals_plain_version(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert result(got) == sorted((plain_row(*r) for r in rows), key=str)


def test_query_over_the_smallest_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in rows]
    got = result(queries.op11_periodic_runs(spark, SF))
    want = sorted((plain_row(*r) for r in rows), key=str)
    assert got == want and sum(w[1] for w in want) > 20


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert periodic.find_runs(periodic.plant(none)).collect() == []
