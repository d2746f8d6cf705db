"""Queries over documents that are handled by joins: one document of all orders, with rings and chains of any lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators import large, rendering, reports, sequences
from ..operators.fixpoint import shared_folder
from ..sources import datasource, documents
from ..sources.mapping import LAYERS_SQL, TRADE_SQL, layers_corpus, orders_corpus, trade_corpus
from .more import _layered_sql
from .registry import ORACLE_SQL, _joined, _query

_OPEN = TRADE_SQL.format(ring="c % 3 <> 0")
_RINGS = TRADE_SQL.format(ring="true")


@_query("""+ numbered as (select comp, row_number() over (order by level, comp) - 1 as number from level)
select number::integer as comp, (row_number() over (partition by c.comp order by k) - 1)::integer as pos, 'o' || k as id, cyclic from comps c join numbered using (comp)""", base=_OPEN, recursive=True)  # fmt: skip
def large_components(spark, sf):
    return large.components(trade_corpus(spark, sf)).select("comp", "pos", "id", "cyclic")


@_query("select 'trade' as doc_id, max(level)::bigint as longest_chain from level", base=_OPEN, recursive=True)
def large_longest_chain(spark, sf):
    return large.longest_chains(trade_corpus(spark, sf))


@_query("""+ up(src, dst) as (select s, arg from given union select u.src, g.arg from up u join given g on g.s = u.dst)
select 'o' || dst as id, count(*) as n from up group by dst""", base=_RINGS, recursive=True)  # fmt: skip
def large_closure_sizes(spark, sf):
    """How many statements each rests on."""
    return large.closure_sizes(trade_corpus(spark, sf, open_every=None), up=True).select("id", "n")


@_query("""+ leads as (select distinct p.part as src, c.part as dst from incidence p join incidence c using (arg) where p.side = 'p' and c.side = 'c'),
down(src, dst) as (select src, dst from leads union select d.src, l.dst from down d join leads l on l.src = d.dst)
select 'p' || src as id, count(*) as n from down group by src""", base=LAYERS_SQL, recursive=True)  # fmt: skip
def layered_closure_sizes(spark, sf):
    """How many statements each leads to; in blocks of columns."""
    return large.closure_sizes(layers_corpus(spark, sf), up=False, block=8192).select("id", "n")


@_query("+" + _layered_sql() + """, leads as (select distinct p.part as s, c.part as t from incidence p join incidence c using (arg) where p.side = 'p' and c.side = 'c'),
way(part, n) as (select part, 0 from props union select t, n + 1 from way join leads on s = way.part)
select 'layers' as doc_id, max(n)::bigint as longest_chain from way""", base=LAYERS_SQL, recursive=True)  # fmt: skip
def layered_longest_chain(spark, sf):
    return large.longest_chains(layers_corpus(spark, sf))


_ARG = "sha256('3:arg,' || strlen('order ' || arg) || ':order ' || arg || case when day is null then ',2:#1,64:' || {0} else ',2:#2,64:' || least({0}, {1}) || ',64:' || greatest({0}, {1}) end || ',2:#1,64:' || prop || ',')"

#: Level by level: each step keeps the rows so far and adds those of the next level.
_RING_IDS = f"""+ props as materialized (select o.k, c.comp, level, sha256('4:prop,' || strlen(text) || ':' || text || ',' || strlen(mode) || ':' || mode || ',') as prop from ords o join comps c using (k) join level using (comp)),
args as materialized (select l.k as arg, l.before, case when y.first.c < l.c then y.first.k end as day, p.prop, p.comp, p.level, b.prop as before_prop from linked l join days y on y.d = l.d join props p on p.k = l.k join props b on b.k = l.before),
done(n, k, just, scc) as (select -1, null::bigint, null::varchar, null::varchar union all select * from (
  select n + 1, k, just, scc from done where n < (select max(level) from level) and (k is not null or n = -1)
  union all
  select x.n, p.k, sha256('7:justscc,64:' || scc || ',64:' || p.prop || ','), scc from (
    select n, comp, sha256('3:scc,' || strlen('#' || count(*)) || ':#' || count(*) || ',' || string_agg('64:' || prop || ',', '' order by prop) || strlen('#' || count(*)) || ':#' || count(*) || ',' || string_agg('64:' || h || ',', '' order by h)) as scc
    from (select a.comp, a.prop, z.n, {_ARG.format("before_prop", "d.just")} as h from args a join (select max(n) + 1 as n from done) z on a.level = z.n left join done d on d.k = a.day) group by n, comp) x join props p using (comp))),
ids as materialized (select k, any_value(just) as just, any_value(scc) as scc from done where k is not null group by k)
"""


@_query(_RING_IDS + "select 'o' || k as id, prop as prop_id, just as just_id, scc from ids join props using (k)", base=_RINGS, recursive=True)
def large_statement_ids(spark, sf):
    """Every statement on a ring, of any lengths; components settled level by level."""
    return large.identities(trade_corpus(spark, sf, open_every=None))[0].select("id", "prop_id", "just_id", "scc")


@_query(_RING_IDS + f"select 'a' || arg as id, {_ARG.format('b.just', 'd.just')} as arg_hash from args a join ids b on b.k = a.before left join ids d on d.k = a.day", base=_RINGS, recursive=True)
def large_argument_hashes(spark, sf):
    return large.identities(trade_corpus(spark, sf, open_every=None))[1].select("id", "arg_hash")


@_query("select doc_id::varchar as doc_id, id, text, mode from statements")
def source_round_trip(spark, sf):
    """Every document through the data source, written and read."""
    datasource.register(spark)
    with shared_folder(spark) as folder:
        documents.to_json(orders_corpus(spark, sf), None).select(F.col("doc_id").cast("string").alias("doc_id"), "json").write.format(datasource.NAME).mode("overwrite").save(folder)
        back = documents.parse(spark.read.format(datasource.NAME).load(folder))
    return back.statements.select("doc_id", "id", "text", "mode")


@_query("""with recursive sized as (select row_number() over (order by doc_id) - 1 as i, greatest(1, ceil(length(coalesce(text, '')) / 3.5))::bigint as t, source is distinct from lag(source) over (order by doc_id) as turn from documents),
pack(i, chunk, used) as (select i, 0, t from sized where i = 0 union all
  select s.i, case when used + t > 6000 or (turn and used * 2 >= 6000) then chunk + 1 else chunk end, case when used + t > 6000 or (turn and used * 2 >= 6000) then t else used + t end
  from pack p join sized s on s.i = p.i + 1)
select i, chunk::bigint as chunk from pack""", base="")  # fmt: skip
def chunks_by_joins(spark, sf):
    """All documents as the paragraphs of one text, headed by their sources."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("all").alias("doc_id"), F.col("doc_id").alias("at"), estimate_tokens(F.coalesce("text", F.lit(""))).alias("t"), "source", F.lit(1).alias("one"))
    rows = sequences.running(docs, "at", "one", "nth").withColumn("i", F.col("nth") - 1)
    before = rows.select("doc_id", (F.col("i") + 1).alias("i"), F.col("source").alias("before"))
    rows = rows.join(before, ["doc_id", "i"], "left").select("doc_id", "i", "t", (~F.col("source").eqNullSafe(F.col("before"))).alias("turn"))
    return sequences.chunk_numbers(rows, 6000).select("i", F.col("chunk").cast("long").alias("chunk"))


# Trees of any depth: SQL takes a node off a document's stack in each step.

_WALK = """+ target as (select doc_id, arg_max(id, ord) as id from statements group by 1),
sides as (select c.doc_id, c.sid, c.arg_key, p.slot, p.sid as leaf from incidence c left join incidence p on p.doc_id = c.doc_id and p.arg_key = c.arg_key and p.side = 'p' where c.side = 'c'),
joint as (select c.doc_id, c.arg_key, c.sid, string_agg('`' || o.sid || '`', ', ' order by o.slot) as also from incidence c join incidence o on o.doc_id = c.doc_id and o.arg_key = c.arg_key and o.side = 'c' and o.sid <> c.sid where c.side = 'c' group by 1, 2, 3),
below as (select doc_id, sid, arg_key, coalesce(slot, 0) as slot, leaf as s, 2 as up, '- *no premises*' as line from sides union all
  select distinct doc_id, sid, arg_key, -1, null, 1, '- via `a' || arg_key || '`' || coalesce(' [' || rule || ']', '') || coalesce(' (jointly concludes ' || also || ')', '') || ': ' || case when trim(justification) = '' then '(no justification given)' else justification end
  from sides s join (select doc_id, ord as arg_key, rule, justification from arguments) a using (doc_id, arg_key) left join joint using (doc_id, arg_key, sid)),
kids as (select doc_id, sid, list({'s': s, 'v': 'a' || arg_key, 'up': up, 'line': line} order by arg_key desc, slot desc) as kids from below group by 1, 2),
walk(doc_id, target, n, stack, met, top, again) as (
  select doc_id, id, -1, [{'s': id, 'v': null::varchar, 'up': 0, 'line': null::varchar}], []::varchar[], null::struct(s varchar, v varchar, up integer, line varchar), false from target
  union all select w.doc_id, target, n + 1,
    list_concat(stack[:len(stack) - 1], case when stack[-1].s is null or list_contains(met, stack[-1].s) then [] else list_transform(coalesce(kids, []), lambda x: {'s': x.s, 'v': x.v, 'up': x.up + stack[-1].up, 'line': x.line}) end),
    case when stack[-1].s is null or list_contains(met, stack[-1].s) then met else list_append(met, stack[-1].s) end, stack[-1], coalesce(list_contains(met, stack[-1].s), false)
  from walk w left join kids k on k.doc_id = w.doc_id and k.sid = w.stack[-1].s where len(stack) > 0)
"""


def _lasts(c):
    """The last statement of each document."""
    return c.statements.groupBy("doc_id").agg(F.max_by("id", "ord").alias("id"))


@_query(_WALK + """select doc_id, target, (row_number() over (partition by doc_id order by n) - 1)::integer as seq, (top.up // 2)::integer as depth, top.v as via_arg, top.s as stmt, again as seen
from walk where top.s is not null""", recursive=True)  # fmt: skip
def deep_tree_rows(spark, sf):
    c = orders_corpus(spark, sf)
    return reports.tree_rows(c, _lasts(c)).select("doc_id", "target", "seq", "depth", "via_arg", "stmt", "seen")


@_query(_WALK + """, shown as (select w.doc_id, target, n, repeat('  ', top.up) || case when top.s is null then top.line
  else '- **' || canon || '** (`' || top.s || '`, ' || mode || ')' || case when again then ' — *see above*' when k.sid is null then ' — *foundation*' else '' end end as line
  from walk w left join statements s on s.doc_id = w.doc_id and s.id = w.top.s left join kids k on k.doc_id = w.doc_id and k.sid = w.top.s where top is not null)
select doc_id, target as statement, string_agg(line, chr(10) order by n) as text from shown group by 1, 2""", recursive=True)  # fmt: skip
def present_cases(spark, sf):
    """The case for the last statement of each document, of any depth."""
    c = orders_corpus(spark, sf)
    case = F.regexp_extract("text", "(?s)## The case\n\n(.*?)\n\n## Foundations reached", 1)
    return rendering.present(c, _lasts(c)).select("doc_id", "statement", case.alias("text"))


_REPORT = "well_founded struct<foundations: array<string>, ungrounded: array<string>>, duplicates array<struct<prop_id: string, ids: array<string>>>, unused array<string>, empty_justifications array<string>, is_ought_gaps array<struct<argument: string>>"


@_query(f"""+ well as ({ORACLE_SQL['well_founded']}), gaps as ({ORACLE_SQL['is_ought_gaps']}), twice as ({ORACLE_SQL['duplicates']}), blank as ({ORACLE_SQL['empty_justifications']}),
w as (select w.doc_id, string_agg(id, ',' order by ord) filter (foundation) as foundations, string_agg(id, ',' order by ord) filter (not grounded) as ungrounded from well w join statements using (doc_id, id) group by 1),
g as (select g.doc_id, string_agg(argument, ',' order by ord) as gaps from gaps g join arguments a on a.doc_id = g.doc_id and a.id = g.argument group by 1),
t as (select doc_id, string_agg(prop_id || '=' || ids, ' ' order by ord) as duplicates from (select t.*, s.ord from twice t join statements s on s.doc_id = t.doc_id and s.id = split_part(t.ids, ',', 1)) group by 1),
b as (select doc_id, string_agg(id, ',' order by ord) as blank from blank join arguments using (doc_id, id) group by 1)
select doc_id, coalesce(foundations, '') as foundations, coalesce(ungrounded, '') as ungrounded, coalesce(duplicates, '') as duplicates, '' as unused, coalesce(blank, '') as empty_justifications, coalesce(gaps, '') as gaps
from w left join g using (doc_id) left join t using (doc_id) left join b using (doc_id)""", recursive=True)  # fmt: skip
def lint_reports(spark, sf):
    """All lints of every document in one report; no statement of this corpus is unused."""
    rows = reports.lint_all(orders_corpus(spark, sf)).withColumn("r", F.from_json("report", _REPORT))
    twice = F.transform("r.duplicates", lambda d: F.concat(d["prop_id"], F.lit("="), _joined(d["ids"])))
    return rows.select("doc_id", _joined("r.well_founded.foundations").alias("foundations"), _joined("r.well_founded.ungrounded").alias("ungrounded"), F.array_join(twice, " ").alias("duplicates"), _joined("r.unused").alias("unused"), _joined("r.empty_justifications").alias("empty_justifications"), _joined("r.is_ought_gaps.argument").alias("gaps"))


# Structural faults.

_S, _A = '[{"id": "s", "text": "S", "mode": "is"}]', '[{"id": "a", "premises": [], "conclusions": ["s"], "justification": "j"}]'


def _text(head: str = '"version": "0.1"', statements: str = _S, arguments: str = _A, more: str = "") -> str:
    return f'{{"format": "{documents.FORMAT}", {head}, "statements": {statements}, "arguments": {arguments}{more}}}'


#: A document by the number of an order, and what is wrong with it.
_CASES: list[tuple[str, list[str]]] = [
    (_text(), []),
    ("[1]", ["document: must be a JSON object"]),
    (_text(head='"name": 1'), ["document: missing required field 'version'", "document: 'name' must be a string"]),
    (_text(more=', "description": null'), ["document: 'description' must be a string"]),
    (_text(more=', "meta": [], "ext": {"x": 1, "y": {}}'), ["document: 'meta' must be an object", "document: ext['x'] must be an object (each ext key is a namespace)"]),
    (_text(statements="{}"), ["document: 'statements' must be an array"]),
    (_text(statements='["s"]'), ["statements[0]: must be an object"]),
    (_text(statements='[{"id": "a b", "text": "", "mode": "is"}]'), ["statements[0]: 'id' must be a non-empty string without whitespace, got 'a b'", "statements[0]: 'text' must be a non-empty string"]),
    (_text(statements='[{"id": "s", "text": "S", "mode": "is"}, {"id": "s", "text": "T", "mode": "is"}]'), ["statements[1]: duplicate statement id 's'"]),
    (_text(arguments='[{"id": "a", "premises": "s", "conclusions": [], "justification": null}]'), ["arguments[0] (a): 'premises' must be an array of statement ids", "arguments[0] (a): 'conclusions' must have at least 1 item(s)", "arguments[0] (a): 'justification' must be a string"]),
    (_text(arguments='[{"id": "a", "premises": ["s", "s", 2], "conclusions": ["s"], "rule": 3, "justification": ""}]'), ["arguments[0] (a): premises[2] must be a statement id (non-empty string without whitespace), got 2", "arguments[0] (a): 'premises' contains duplicate ids", "arguments[0] (a): 'rule' must be a string"]),
    (_text(arguments='[{"premises": [], "conclusions": ["s"], "justification": "j", "why": 1}]'), ["arguments[0]: unknown field 'why' (extensions belong under 'ext')", "arguments[0]: missing required field 'id'"]),
    (_text(arguments='[{"id": "a", "premises": ["t"], "conclusions": ["u"], "justification": "j"}, {"id": "a", "premises": [], "conclusions": ["s"], "justification": "j"}]'), ["arguments[0] (a): premises references unknown statement 't'", "arguments[0] (a): conclusions references unknown statement 'u'", "arguments[1]: duplicate argument id 'a'"]),
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SAID = ", ".join(f"({i}, {j}, {_quoted(m)})" for i, (_, found) in enumerate(_CASES) for j, m in enumerate(found))


@_query(f"select o_orderkey::varchar as doc_id, seq::bigint as seq, message from orders join (values {_SAID}) as said(fault, seq, message) on fault = o_orderkey % {len(_CASES)}", base="")
def structural_faults(spark, sf):
    """A document for each order, with a fault by its number."""
    text = F.element_at(F.array(*(F.lit(t) for t, _ in _CASES)), (F.col("o_orderkey") % len(_CASES) + 1).cast("int"))
    raw = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), text.alias("json"))
    return documents.parse(raw).problems.select("doc_id", F.col("seq").cast("long").alias("seq"), "message")
