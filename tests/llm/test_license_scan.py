"""Canonical digests against a plain version, and the registered query against DuckDB."""

import hashlib
import textwrap

import regex

from innsight.llm import license_scan as S, queries
from innsight.oracle.compare import duckdb_connection

SF = "/root/testdata/sf0.01"


SHORT = {"inc", "ltd", "co", "corp", "jr", "sr", "dr", "st"}


def without_notices(text):
    """``text`` (lower case) less its copyright notices, read character by character."""
    if not any(x in text for x in ("copyright", "(c)", "©")):
        return text
    text = regex.sub(r"all[ \t\n\x0b\f\r]+rights[ \t\n\x0b\f\r]+reserved\.?", ". ", text)
    for opening in S.OPENINGS:
        text = regex.sub(opening.replace(" ", r"[ \t\n\x0b\f\r]+"), r"\n\g<0>", text)
    start, out, at = regex.compile(r"copyright[ \t]*(\(c\)|©|(19|20)[0-9]{2})|©|\(c\)[ \t]*(copyright[ \t]+)?(19|20)[0-9]{2}"), [], 0
    initials = regex.compile(r"[ \t]([a-z]+)\.(?:[a-z]\.)*")
    while m := start.search(text, at):
        out.append(text[at:m.start()] + " ")
        at, n = m.end(), 0
        while n < S.NOTICE_CHARS and at < len(text) and text[at] != "\n":
            short = initials.match(text, at)
            if short and (len(short[1]) == 1 or short[1] in SHORT):
                at += len(short[0])
            elif text[at] != ".":
                at += 1
            elif at + 1 < len(text) and not text[at + 1].isspace() and text[at + 1] != ".":
                at += 2
            else:
                break
            n += 1
        at += text[at:at + 1] == "."
    return "".join([*out, text[at:]])


def spelt(text):
    for old, new in S.SPELLINGS:
        text = text.replace(old, new)
    return text


def words(text):
    return regex.sub(r"[^\p{L}\p{N}\n]+", " ", without_notices((text or "").replace("\r", "").lower()))


def canonical(text):
    lines = [regex.sub(" *all rights reserved *", " ", x).strip() for x in spelt(words(text)).split("\n")]
    return [x for x in lines if x]


def whole(text):
    joined = spelt(" ".join(words(text).split()))
    joined = regex.sub(" *all rights reserved *", " ", joined).strip()
    return regex.sub("^(the )?(mit|expat|x11|isc|zlib|bsd( [0234] clause)?( new| revised| simplified)?)( original)? license( (mit|expat|x11|isc))? ", "", joined)


def digest(text):
    return hashlib.sha256(whole(text).encode()).hexdigest()


def expected(rows):
    known = {}
    for i, t in S.KNOWN:
        known[digest(t)] = min(i, known.get(digest(t), i))
    out = []
    for d, t in rows:
        notes = {known.get(hashlib.sha256(x.encode()).hexdigest()) for x in canonical(t)} - {None}
        out.append((d, digest(t), known.get(digest(t)), ",".join(sorted(notes))))
    return sorted(out, key=str)


MIT = S.KNOWN[12][1]
ROWS = [(1, None), (2, ""), (3, "Licensed  under CC BY-NC 4.0!!"), (4, "prose\nReleased under the MIT Licence.\nprose\nspdx-license-identifier: mit"),
        (5, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + MIT.upper()), (6, MIT.replace("\n", "\r\n")),
        (7, MIT.replace("\n", " ")), (7, MIT + "\nand more"), (8, "© me"), (8, "© me"), (None, "Licensed under CC BY-NC 4.0."), (9, "x" * 100_000)]


def test_plain_version(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS lines", "2 AS unit", "3 AS `row`")
    got = [tuple(r) for r in S.scan(df).collect()]
    assert sorted(got, key=str) == expected(ROWS)
    assert {r[2] for r in got if r[0] in (5, 6)} == {"MIT"} and {r[2] for r in got if r[0] == 7} == {"MIT", None}
    assert S.scan(df.limit(0)).count() == 0


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_KNOWN", 1)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.scan(df).collect()), key=str) == expected(ROWS)


def test_documents_against_duckdb(spark):
    got = sorted((tuple(r) for r in queries.op9_license_scan(spark, SF).collect()), key=str)
    assert got == sorted(duckdb_connection(SF).execute(queries.ORACLE["op9_license_scan"]).fetchall(), key=str)
    assert any(r[3] for r in got)


def test_no_python_in_the_plan(spark):
    plan = queries.op9_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


MIT_PUBLISHED = """MIT License

Copyright (c) 2021 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC_PUBLISHED = """ISC License

Copyright (c) 2021 A. Person

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""


def test_whole_licenses_published_and_unwrapped(spark):
    texts = [("MIT", MIT_PUBLISHED), ("ISC", ISC_PUBLISHED), *S._WHOLE]
    assert len(S._WHOLE) == 19
    rows = [(i, t) for i, t in texts] + [(i, S.unwrapped(t)) for i, t in texts] + [("", ""), ("", "Copyright (c) 2020 X")]
    got = S.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["license_id"] or "") for r in got) == sorted((i, i) for i, _ in rows)


def rewrapped(text, width):
    """``text`` with each paragraph wrapped anew."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))


def test_any_wrapping_is_known(spark):
    """MIT, ISC and BSD at all widths, on one line, as one paragraph, without a title, with other holders."""
    bsd = dict(S._WHOLE)["BSD-2-Clause"]
    texts = {"MIT": MIT_PUBLISHED, "ISC": ISC_PUBLISHED, "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) 2019, Jo Doe\nAll rights reserved.\n\n" + bsd}
    rows = []
    for i, t in texts.items():
        body = t.split("\n\n", 2)[2]
        rows += [(i, rewrapped(t, w)) for w in range(40, 121)]
        rows += [(i, " ".join(t.split())), (i, body), (i, " ".join(body.split())), (i, f"Copyright (c) 2024 Jo Doe. {' '.join(body.split())}"),
                 (i, textwrap.fill(" ".join(t.split()), 64))]
        rows += [(i, t.replace("Copyright (c) 2021 A. Person", n)) for n in (
            "© J. R. Person, Ltd. and others", "(c) 2001-2019 Some Co. Inc. <a@b.org>", "Copyright 2020 X\nCopyright © 2021 Y", "Copyright (C) 1999 A.B. Person")]
    got = S.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    known = {digest(t) for _, t in S.KNOWN}
    assert not [(i, t[:200]) for i, t in rows if digest(t) not in known]
    assert len(got) == len(rows) and all(r["license_id"] == r["doc_id"] for r in got)


def test_words_of_the_licence_stay(spark):
    """The word alone is no notice: what it stands in is kept, and a text that lacks it is another one."""
    changed = MIT_PUBLISHED.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
    rows = [("a", changed), ("b", "Copyright holders are named."), ("c", "named"), ("d", "Copyright (c) 2020 " + "x" * 400 + " tail")]
    got = {r["doc_id"]: r for r in S.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got["a"]["license_id"] is None and got["b"]["canonical_sha256"] != got["c"]["canonical_sha256"]
    assert got["d"]["canonical_sha256"] == digest(rows[3][1])


def test_missing_data_files_fail(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys
    source = pathlib.Path(S.__file__).parent
    (tmp_path / "innsight" / "llm").mkdir(parents=True)
    for f in ("../__init__.py", "__init__.py", "license_scan.py", "common.py"):
        shutil.copy(source / f, tmp_path / "innsight" / "llm" / f)
    out = subprocess.run([sys.executable, "-c", "import innsight.llm.license_scan"], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert "without its data files" in out.stderr
