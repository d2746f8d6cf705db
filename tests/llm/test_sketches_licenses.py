import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from arggraph_spark.llm import licenses, queries, sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, size=5):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(texts, ids):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    out = {}
    for k, i in enumerate(order):
        t, n = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        out[ids[i]] = (t[: len(t) - len(t) // 2] + n[: len(t) // 2], n)
    return out


@pytest.mark.parametrize("block", [1, 2, 5, 1024])
def test_edits_against_python(spark, documents, odd_texts, block):
    ids = [None, *(i * 7 % 101 for i in range(1, len(odd_texts)))]
    want = edited(odd_texts, ids)
    rows = {r.doc_id: r for r in sketches.fingerprints(documents(odd_texts, ids=ids, extra=True), block=block).collect()}
    assert len(rows) == len(ids)
    for i, t in zip(ids, odd_texts, strict=True):
        r = rows[i]
        assert (r.n_chars, r.edited_text) == (len(t or ""), want[i][0])
        for sketch, text in ((r.sketch, t), (r.edited_sketch, want[i][0]), (r.next_sketch, want[i][1])):
            assert len(sketch) == min(sketches.K, len(shingles(text))) and sketch == sorted(set(sketch))


def test_estimates(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:2000]), " ".join(words[1000:]), "a b c", "", " ".join(words[:60])]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    df = sketches.with_sketch(sketches.with_sketch(df, "a", "x"), "b", "y")
    rows = df.select("a", "b", sketches.resemblance(F.col("x"), F.col("y")).alias("j"), sketches.containment(F.col("x"), F.col("y")).alias("c"), sketches.distinct_shingles(F.col("x")).alias("n")).collect()
    for r in rows:
        a, b = shingles(r.a), shingles(r.b)
        assert abs(r.j - jaccard(a, b)) < 0.13
        assert abs(r.c - (len(a & b) / len(a) if a else 1.0)) < 0.3
        assert abs(r.n - len(a)) <= 0.3 * len(a)


def test_merging_parts_gives_the_wholes_sketch(spark):
    texts = [" ".join(f"{g}{i % 400}" for i in range(s, s + 300)) for g in "ab" for s in (0, 200, 350)]
    df = sketches.with_sketch(spark.createDataFrame([(t[0], t) for t in texts], "g string, t string"), "t", "sketch")
    want = {}
    for r in df.collect():
        want[r.g] = sorted({*want.get(r.g, []), *r.sketch})
    got = {r.g: r.sketch for r in sketches.merge_parts(df, ["g"]).collect()}
    assert got == {g: v[: sketches.K] for g, v in want.items()}


def test_repeated_rows_and_empty(spark, documents):
    docs = documents(["aa", "aa", "bbbb", "c"], ids=[1, 1, 1, 2])
    rows = sketches.fingerprints(docs).collect()
    assert len(rows) == 4 and sorted(r.edited_text for r in rows if r.n_chars == 2)[0] == sorted(r.edited_text for r in rows if r.n_chars == 2)[1]
    assert sketches.fingerprints(documents(["x"]).filter("false")).collect() == []


def test_fingerprint_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = edited(list(texts.values()), list(texts))
    rows = queries.op7_document_fingerprints(spark, sf).collect()
    assert len(rows) == len(texts)
    prints = {}
    for r in rows:
        e, n = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(texts[r.doc_id]), hashlib.sha256(e.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(shingles(texts[r.doc_id]), shingles(e))) < 0.2
        assert abs(r.near_next - jaccard(shingles(texts[r.doc_id]), shingles(n))) < 0.2
        assert len(base64.b64decode(r.fingerprint)) == 8 * min(sketches.K, len(shingles(texts[r.doc_id])))
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


MIT = """Some words first.
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
# THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
# IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
# FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. More."""


def test_licences(spark, documents, odd_texts):
    texts = [
        *odd_texts,
        MIT,
        "x\nReleased under the MIT License.\ny",
        "a. Licensed under the Apache License, Version 2.0. Released under the MIT License. b",
        "released UNDER\nthe mit\nlicense",
        "not Released under the MIT License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "word\n" * 3000 + "SPDX-License-Identifier: MIT\n",
    ]
    rows = {r.doc_id: r for r in licenses.scan(documents(texts, extra=True)).collect()}
    n = len(odd_texts)
    assert all(rows[i].n_sentences == 0 and rows[i].rules == "" for i in range(n))
    assert (rows[n].licenses, rows[n].sentence_ids) == ("MIT", "mit-grant,mit-condition,mit-as-is")
    assert rows[n + 1].rules == "mit-notice"
    assert rows[n + 2].licenses == "Apache-2.0,MIT"
    assert rows[n + 3].rules == "mit-notice"
    assert rows[n + 4].n_sentences == 0
    assert (rows[n + 5].sentence_ids, rows[n + 5].rules) == ("bsd-grant", "")
    assert rows[n + 6].rules == "mit-spdx"
    assert licenses.scan(documents(["x"]).filter("false")).collect() == []


def test_every_sentence_is_found_and_every_rule_matches(spark, documents):
    by_id = licenses.SENTENCES
    texts = [*(f"Before.\n{s}.\nAfter." for s in by_id.values()), *(". ".join(by_id[i] for i in seq) + "." for _, _, seq in licenses.RULES)]
    rows = [r for r in sorted(licenses.scan(documents(texts)).collect())]
    assert [r.sentence_ids for r in rows[: len(by_id)]] == list(by_id)
    for r, (name, key, _) in zip(rows[len(by_id) :], licenses.RULES, strict=True):
        assert name in r.rules.split(",") and key in r.licenses.split(",")


def test_licences_of_any_layout(spark, documents):
    import textwrap

    mit = " ".join(MIT.replace("#", "").split()[3:])
    by_id = licenses.SENTENCES
    bsd = f"{by_id['bsd-grant']} 1. {by_id['bsd-source']}. 2. {by_id['bsd-binary']}. 3. {by_id['bsd-endorse']}. THIS SOFTWARE"
    texts = [mit, bsd, *(textwrap.fill(x, w, initial_indent="// ", subsequent_indent="// ", break_long_words=False) for w in (44, 30, 9) for x in (mit, bsd))]
    rows = [r for r in sorted(licenses.scan(documents(texts)).collect())]
    for r in rows[::2]:
        assert (r.sentence_ids, r.rules) == ("mit-grant,mit-condition,mit-as-is", "mit-text")
    for r in rows[1::2]:
        assert (r.sentence_ids, r.rules) == ("bsd-grant,bsd-source,bsd-binary,bsd-endorse", "bsd-3-text")


def layouts():
    import textwrap

    by_id = licenses.SENTENCES
    mit = " ".join(MIT.replace("#", "").split()[3:])
    apache = ". ".join(by_id[i] for i in ("apache-notice-the", "apache-compliance", "apache-copy", "apache-as-is", "apache-see")).replace('License"). you', 'License"); you') + "."
    bsd2 = f"{by_id['bsd-grant']} 1. {by_id['bsd-source']}. 2. {by_id['bsd-binary']}. {by_id['bsd-as-is']}. {by_id['bsd-liability']}."
    bsd3 = f"{by_id['bsd-grant']} * {by_id['bsd-source']}. * {by_id['bsd-binary']}. * {by_id['bsd-endorse']}. {by_id['bsd-as-is']}."
    for name, text in (("MIT", mit), ("Apache-2.0", apache), ("BSD-2-Clause", bsd2), ("BSD-3-Clause", bsd3), ("BSD-2-Clause,BSD-3-Clause", bsd2 + "\n" + bsd3)):
        yield name, text
        for w in range(36, 81, 4):
            yield name, textwrap.fill(text, w, initial_indent=" * ", subsequent_indent=" * ", break_long_words=False)


def test_each_layout_gives_just_its_licence(documents):
    cases = list(layouts())
    for (name, text), r in zip(cases, sorted(licenses.scan(documents([t for _, t in cases])).collect()), strict=True):
        assert r.licenses == name, text


def test_sql_agrees_on_layouts_and_odd_texts(documents, odd_texts):
    import duckdb

    texts = [*(t for _, t in layouts()), *odd_texts, *licenses.SENTENCES.values(), "x: Released under the MIT License:\n\n\nLicensed under CC BY 4.0?! Licensed under CC BY-SA 4.0", "word\n" * 3000 + MIT]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = sorted(con.execute(licenses.oracle_sql()).fetchall())
    assert sorted(tuple(r) for r in licenses.scan(documents(texts)).collect()) == want


def usual():
    """Usual texts that name a holder or differ in small words, with the licence each has."""
    s = licenses.SENTENCES
    grant = f"{s['bsd-grant']}\n\n1. {s['bsd-source']}.\n2. {s['bsd-binary']}.\n"
    endorse = "Neither the name of Example, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    sold = s["bsd-as-is"].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE REGENTS AND CONTRIBUTORS")
    yield "BSD-3-Clause", f"{grant}3. {endorse}.\n\n{sold}."
    yield "BSD-3-Clause", (f"{grant}(c) {endorse}.\n").replace("1.", "(a)").replace("2.", "(b)")
    yield "BSD-3-Clause", f"{grant}3. The names of the Widget project's authors may not be used to endorse or promote products derived from this software without prior written permission."
    yield "BSD-3-Clause", f"{grant}3. Neither the name of A nor that of any friend of theirs may be taken by anybody to endorse or promote products derived from this software without specific prior written permission."
    yield "BSD-4-Clause", f"{grant}3. {s['bsd-advertising']}\n   This product includes software developed by Example.\n4. {endorse}."
    yield "BSD-2-Clause", f"{grant}\n{sold}."
    yield "BSD-2-Clause", f"{grant}3. Neither the name of {'word ' * 60}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    condition = s["mit-condition"].replace("permission notice", "permission notice (including the next paragraph)")
    yield "MIT", f"{s['mit-grant']}\n{condition}.\n{s['mit-as-is']}.\nIN NO EVENT SHALL Example BE LIABLE"
    yield "MIT", f"{s['mit-grant']}\n{s['mit-condition']}."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     https://www.apache.org/licenses/LICENSE-2.0\n#\n'
    yield "Apache-2.0", f"# {apache}# {s['apache-as-is']}.\n# {s['apache-see']}."
    yield "GPL-2.0", s["gpl2-only-grant"] + "."
    yield "GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright"
    yield "", "The name of " + "x" * 41 + " may not be used to endorse or promote products derived from this software without prior written permission."


def test_usual_forms_have_just_their_licence(documents):
    cases = list(usual())
    rows = sorted(licenses.scan(documents([t for _, t in cases])).collect())
    assert [r.licenses for r in rows] == [name for name, _ in cases]
    assert "apache-2.0-header" in rows[9].rules.split(",")


def test_sql_agrees_on_usual_forms(documents):
    import duckdb

    forms = [f"{head} {'Some Holder, Inc. and' * bool(gap)} {tail}." for head, gap, tail, _ in licenses.variants()]
    texts = [*(t for _, t in usual()), *forms, *(f.replace(" ", "\n// ") for f in forms)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = sorted(con.execute(licenses.oracle_sql()).fetchall())
    got = sorted(tuple(r) for r in licenses.scan(documents(texts)).collect())
    assert got == want
    n = len(texts) - 2 * len(forms)
    assert all(v[3] in r[2].split(",") for v, r in zip(licenses.variants(), got[n:]))
