"""Pages, prompts and small helpers."""

import re
from html.parser import HTMLParser

from fixtures import cycle
from pyspark.sql import functions as F

from arggraph_spark.functions import text
from arggraph_spark.operators import extraction, graph, prompts, reports
from arggraph_spark.sources import pages
from arggraph_spark.sources.corpus import corpus_of


def test_pages_become_tagged_text(spark):
    html = "<div>skip</div><p>before</p><h1>Part <b>One</b></h1><p>a<br>b &amp; c</p><p> </p><p>d</p><h2>Note</h2><p>e<p>f</p></p><pre>x</pre><p>open"
    rows = spark.createDataFrame([(1, html), (2, None), (3, "<h3>x</h3>")], "page_id long, html string")
    got = {r.doc_id: r.text for r in pages.tagged_text(rows).collect()}
    assert got[1] == "before\n\n# Part One\n\n[1.1] a b & c\n\n[1.2] d\n\n# Note\n\n[2.1] f\n\n[2.2] e\n"
    assert got[2] == "" and got[3] == "# x\n"
    odd = '<P CLASS="a > b">one<!-- <p>no</p> --> &lt;two&gt;</P>\n<p\nid=x>a<script>if (a<b) "</p>";</script>b</p><p/><pre>x</div></pre><p>1 < 2</p><p>&eacute;<BR/>z</p></p>'
    rows_ = spark.createDataFrame([(1, odd)], "page_id long, html string")
    assert [r.text for r in pages.tagged_blocks(rows_).orderBy("n").collect()] == ["one <two>", 'aif (a<b) "</p>";b', "1 < 2", "é z"]
    only = F.when(F.upper("text") == "PART ONE", "I")
    assert "[I.3] f" in {r.doc_id: r.text for r in pages.tagged_text(rows, part=only).collect()}[1]
    seg = extraction.segmentation(pages.tagged_text(rows)).collect()
    assert {(r.doc_id, r.mode, r.paragraphs, r.skipped) for r in seg} == {(1, "tagged", 4, 1), (2, "untagged", 0, 0), (3, "untagged", 0, 0)}


def test_pages_of_the_table(spark):
    """Against a walk over the parser's events of every page of the smallest table."""

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.out = [], []

        def handle_starttag(self, tag, attrs):
            if tag in ("h1", "h2", "h3", "p", "div", "pre"):
                self.stack.append([tag, ""])
            elif tag == "br" and self.stack:
                self.stack[-1][1] += " "

        def handle_endtag(self, tag):
            if self.stack and self.stack[-1][0] == tag:
                kind, words = self.stack.pop()
                if words := " ".join(words.split()):
                    self.out.append((kind, words))

        def handle_data(self, data):
            if self.stack:
                self.stack[-1][1] += data

    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.doc_id: r.text for r in pages.tagged_text(table).collect()}
    for r in table.collect():
        w = Walk()
        w.feed(r.html or "")
        w.close()
        lines, part, k = [], 0, 0
        for kind, words in w.out:
            if kind in ("h1", "h2", "h3"):
                part, k = part + 1, 0
                lines.append(f"# {words}")
            elif kind == "p":
                k += 1
                lines.append(f"[{part}.{k}] {words}" if part else words)
        assert got[r.page_id] == ("\n\n".join(lines) + "\n" if lines else "")


def test_prompts_and_their_hashes(spark):
    chunks = spark.createDataFrame([("d", 0, "[p1] Ä \"q\"\t/x "), ("d", 1, "[p2] b")], "doc_id string, chunk int, text string")
    s = spark.createDataFrame([("d", 0, "b1", "is", "B", 0), ("d", 1, "a1", "ought", "A", 0)], "doc_id string, seq long, id string, mode string, text string, batch int")
    a = spark.createDataFrame([("d", 0, "x", [], ["a1", "b1"])], "doc_id string, ord int, id string, premises array<string>, conclusions array<string>")
    one = prompts.statement_prompts(chunks, F.lit("N")).orderBy("call").first()
    assert one.user == 'Document: N\n\n[p1] Ä "q"\t/x \n\nExtract the candidate statements from the paragraphs above.'
    merge = prompts.merge_prompts(s).first().user
    assert merge.startswith("Candidate statements (id [mode]: text):\nb1 [is]: B\na1 [ought]: A\n\nPropose merges")
    shown = spark.createDataFrame([("d", 0, "a1")], "doc_id string, chunk int, id string")
    both = [r.user for r in prompts.argument_prompts(chunks, shown, s).orderBy("call").collect()]
    assert "(id [mode]: text):\na1 [ought]: A\n\nExtract the arguments" in both[0] and "text):\n\n\nExtract" in both[1]
    assert "x: (none) => a1, b1\n\nPropose the missing" in prompts.link_prompts(s, a).first().user
    assert "conclusions):\n(none)\n\n" in prompts.link_prompts(s, a.limit(0)).first().user
    schema = {"type": "object", "b": ["é"], "a": 1}
    for r in prompts.with_hash(prompts.statement_prompts(chunks), "sys \"é\"\n", schema).collect():
        assert r.request_hash == extraction.request_hash("sys \"é\"\n", r.user, schema)


def test_ellipsis_wrapping_and_numbers(spark):
    def wrapped(t, width, most):
        words, lines, cur = re.sub(r"\s+", " ", t).strip().split(" "), [], ""
        for w in words:
            if cur and len(cur) + 1 + len(w) > width:
                lines.append(cur)
                cur = ""
            cur = f"{cur} {w}" if cur else w
        lines += [cur] if cur else []
        if len(lines) > most:
            rest = " ".join(lines[most - 1 :])
            lines = [*lines[: most - 1], rest if len(rest) <= width else rest[: width - 1] + "…"]
        return lines

    texts = ["", "one", "  a \n b  ", "word " * 40, "x" * 50 + " y", "aa bb cc dd ee"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for width, most in ((10, 2), (5, 3), (60, 1)):
        got = [r[0] for r in df.select(text.wrap_lines(F.col("t"), width, most)).collect()]
        assert got == [wrapped(t, width, most) for t in texts]
    assert [r[0] for r in df.select(text.ellipsis(F.col("t"), 9)).collect()] == ["", "one", "a b", "word wor…", "xxxxxxxx…", "aa bb cc…"]
    numbers = [0.1, 1e22, 1.0, -0.0, 5e-324, 123456789.125]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select(text.float_repr("x")).collect()
    assert [r[0] for r in rows] == [repr(x) for x in numbers]
    assert spark.range(1).select(text.short_hash(F.lit("0123456789"))).first()[0] == "01234567"


def test_many_cycles_in_one_document(spark):
    """Ten thousand rings of two in one document take seconds, not hours."""
    n = 10_000
    d = {"statements": [{"id": f"{c}{i}", "text": f"{c}{i}", "mode": "is"} for i in range(n) for c in "ab"], "arguments": []}
    for i in range(n):
        d["arguments"] += [{"id": f"x{i}", "premises": [f"a{i}"], "conclusions": [f"b{i}"], "justification": "j"}, {"id": f"y{i}", "premises": [f"b{i}"], "conclusions": [f"a{i}"], "justification": "j"}]
    rings = reports.cycles(corpus_of(spark, {"d": d})).collect()
    assert len(rings) == n and all(len(r.internal_arguments) == 2 and not r.boundary_arguments for r in rings)


def test_chain_longer_than_the_merged_rounds(spark):
    n = 40
    d = {"statements": [{"id": f"s{i}", "text": "t", "mode": "is"} for i in range(n)], "arguments": [{"id": f"a{i}", "premises": [f"s{i}"], "conclusions": [f"s{i + 1}"], "justification": "j"} for i in range(n - 1)]}
    c = corpus_of(spark, {"d": d})
    assert graph.closure(c.edges, spark.createDataFrame([("d", f"s{n - 1}")], "doc_id string, id string")).count() == n - 1
    assert {r.id for r in graph.grounded_by_joins(corpus_of(spark, {"d": cycle()})).collect()} == set("pxyzq")
