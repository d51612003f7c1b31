"""Every row is judged by its own text, every listed tag is known, and full
texts are found where they stand."""

import hashlib

from shelfsight.llm import licenses


def result(spark, texts, ids=None):
    rows = [(None if ids is None else ids[i], t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, whole int")
    return [(r.licenses, r.n_units, r.is_license) for r in licenses.scan_licenses(df).collect()]


def test_rows_share_nothing(spark):
    mit = licenses._MIT
    texts = [mit, "an unrelated story", None, "", mit, "SPDX-License-Identifier: MIT\n" * 3]
    want = [("MIT", 1, True), ("", 0, False), ("", 0, False), ("", 0, False), ("MIT", 1, True), ("MIT", 3, False)]
    assert sorted(result(spark, texts)) == sorted(want)
    assert sorted(result(spark, texts, [7] * 6)) == sorted(want)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_tag_and_every_full_text(spark):
    tags = [(name, tag) for name, _, ids in licenses.SPDX for tag in ids]
    got = result(spark, [f"# spdx-license-identifier: {tag}\nx = 1" for _, tag in tags], list(range(len(tags))))
    assert sorted(n for n, _, _ in got) == sorted(n for n, _ in tags)
    texts = licenses.FULL_TEXTS
    got = result(spark, [f"intro words {t} and more words" for _, _, t in texts], list(range(len(texts))))
    assert sorted(n for n, _, _ in got) == sorted(n for n, _, _ in texts)


def plain_inside(form, forms):
    """Names of the full texts that stand in a canonical text as whole words."""
    return {name for name, f in forms if f" {f} " in f" {form} " and f != form}


def test_stretches_equal_a_plain_search(spark):
    known = licenses._known(spark, licenses.FULL_TEXTS).collect()
    forms = [(r.license, r.form) for r in known]
    t = licenses._tables(spark, tuple(licenses.LICENSES), tuple(licenses.FULL_TEXTS))
    short = sorted({f for _, f in forms}, key=len)[:6]
    texts = ["a " + short[0] + " b", short[1][:-9], short[2] + " " + short[3], "x" + short[0], short[4] + "x", short[5], "permission is hereby granted",
             " ".join(short)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, form string")
    from pyspark.sql import functions as F
    for r in df.select("form", licenses._texts_inside(F.col("form"), t).alias("d")).collect():
        names = {x for x, f in forms if hashlib.sha256(f.encode()).hexdigest() in r.d and f != r.form}
        assert names == plain_inside(r.form, forms)
