"""Parts of a scope link however far apart they are and however long."""

import pytest

from shelfsight.llm import secrets

URL = "https://db.example.org/" + "p" * 400
TOKEN = "token = " + "A" * 800


@pytest.mark.parametrize("text, kinds", [
    (URL + "\npassword: hunter22", {"endpoint", "short"}),                 # behind a long URL
    (TOKEN + "\nuser=bob", {"assign", "login"}),                           # behind a long token
    ("user=bob\n" + "filler words\n" * 90 + "secret: short77", {"login", "short"}),
    ("user=bob\n\nsecret: short77", set()),                                # two scopes
    ("user=bob\nhttps://db.example.org/x", set()),                         # no secret
    ("user=" + "k" * 150 + "\nsecret: short77", {"login", "short"})])
def test_scopes(spark, text, kinds):
    spans = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert {s.kind for s in spans} == kinds
    assert all(text[s.end:s.end + 1] in ("", "\n") for s in spans)  # whole runs
