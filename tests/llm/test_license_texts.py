"""Full licence texts, alone and inside longer documents, and notices over
several lines."""

from pyspark.sql import functions as F

from shelfsight.llm import licenses

BSD = """Copyright (c) 2019, A. Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    * Redistributions of source code must retain the above copyright
      notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright
      notice, this list of conditions and the following disclaimer in the
      documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
LONG = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")


def commented(text):
    return "".join(f" * {x}\n" for x in text.split("\n"))


def test_full_texts(spark):
    mit = next(t for n, _, t in licenses.LICENSES if n == "MIT" and t.startswith("Permission"))
    want, texts = [], []

    def case(text, *result):
        texts.append(text)
        want.append(result)
    case(BSD, "BSD-2-Clause", True)
    case("BSD 2-Clause License\n\n" + BSD, "BSD-2-Clause", True)
    case("/*\n" + commented(BSD) + " */\nint main() {}\n", "BSD-2-Clause", False)
    case("# Tool\n# " + mit.replace("\n", "\n# ") + "\nimport os\n", "MIT", False)
    for name in LONG:
        text = licenses._read(name)
        case(text, name, True)
        case("Read me.\n\n" + text + "\nThe end.", name, False)
    case("x = 1\n\n// Licensed under the\n// MIT License.\n\ny = 2", "MIT", False)
    case(mit[:-20] + "\n\nmore", "", False)
    case("not released under\nthe MIT license\n\nx", "", False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("form", F.lit(1))
    got = {r.doc_id: (r.licenses, r.is_license) for r in licenses.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(want))] == want
