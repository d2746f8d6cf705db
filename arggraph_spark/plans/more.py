"""Further queries over the test tables: walks, identities on cycles, merges, validation, edits, extraction, rendering."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import editing, extraction, graph, identity, prompts, rendering, reports, versions
from ..operators.fixpoint import cut
from ..sources import documents, pages
from ..sources.corpus import Corpus
from ..sources.mapping import LAYERS_SQL, layers_corpus, orders_corpus
from .registry import _DIFF, _DOT_SQL, _LINES, _MERGE, _PLAN, _SCC, _UP, ORACLE_SQL, _joined, _layered_sql, _layers_edited, _query, _sides

def _null():
    return F.lit(None).cast("string")


def _table(spark, sf, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sorted(c: str):
    return _joined(F.array_sort(c))


# Walks.

_DOWN_ARGS = _UP + """, mine as (select doc_id, dst as src, src as dst from up union select doc_id, id, id from statements)
select m.doc_id, m.src as statement, string_agg(distinct i.aid, ',' order by i.aid) as arguments
from mine m join incidence i on i.doc_id = m.doc_id and i.sid = m.dst and side = 'p' group by 1, 2"""


@_query(_DOWN_ARGS, recursive=True)
def supported_arguments(spark, sf):
    out = reports.supports(orders_corpus(spark, sf), report=False).filter(F.size("closure_arguments") > 0)
    return out.select("doc_id", "statement", _sorted("closure_arguments").alias("arguments"))


@_query(_UP + " select doc_id, src as statement, count(*) as n, string_agg(dst, ',' order by dst) as closure from up group by 1, 2", recursive=True)
def rests_on_statements(spark, sf):
    out = reports.rests_on(orders_corpus(spark, sf), report=False).filter(F.size("closure_statements") > 0)
    return out.select("doc_id", "statement", F.size("closure_statements").cast("long").alias("n"), _sorted("closure_statements").alias("closure"))


@_query(_SCC + """, mine as (select doc_id, src, dst from up union select doc_id, id, id from statements)
select distinct m.doc_id, m.src as statement, r.members from mine m join ring r on r.doc_id = m.doc_id and r.id = m.dst""", recursive=True)  # fmt: skip
def rests_on_cycles(spark, sf):
    out = reports.rests_on(orders_corpus(spark, sf), report=False).select("doc_id", "statement", F.explode("sccs").alias("ring"))
    return out.select("doc_id", "statement", _sorted("ring").alias("members"))


_TREE = """+ into_ as (select c.doc_id, c.sid as target, c.arg_key, p.sid as leaf, p.slot from incidence c join incidence p on p.doc_id = c.doc_id and p.arg_key = c.arg_key and p.side = 'p' where c.side = 'c'),
flat as (select *, row_number() over (partition by doc_id, target order by arg_key, slot) as seq, row_number() over (partition by doc_id, target, leaf order by arg_key, slot) as nth from into_),
argued as (select distinct doc_id, sid from incidence where side = 'c')
select doc_id, id as target, 0::integer as seq, 0::integer as depth, null::varchar as via_arg, id as stmt, false as seen, false as truncated from statements
union all select f.doc_id, target, seq::integer, 1::integer, 'a' || arg_key, leaf, leaf = target, leaf <> target and a.sid is not null and nth = 1 from flat f left join argued a on a.doc_id = f.doc_id and a.sid = f.leaf where not (nth > 1 and leaf <> target)
union all select f.doc_id, target, seq::integer, 1::integer, 'a' || arg_key, leaf, true, false from flat f where nth > 1 and leaf <> target"""


@_query(_TREE)
def tree_rows(spark, sf):
    """Trees of depth 1: a statement met again is seen, one with arguments of its own truncated."""
    return reports.tree_rows(orders_corpus(spark, sf), depth=1).select("doc_id", "target", "seq", "depth", "via_arg", "stmt", "seen", "truncated")


@_query("""+ given as (select doc_id, id from statements where ord % 7 = 0),
need(doc_id, src, dst) as (select doc_id, id, id from statements union
  select n.doc_id, n.src, e.src from need n join edges e on e.doc_id = n.doc_id and e.dst = n.dst
  where n.src = n.dst or not exists (select 1 from given g where g.doc_id = n.doc_id and g.id = n.dst))
select n.doc_id, n.src as statement, string_agg(n.dst, ',' order by n.dst) as given from need n join given g on g.doc_id = n.doc_id and g.id = n.dst
where not exists (select 1 from given s where s.doc_id = n.doc_id and s.id = n.src) group by 1, 2
union all select doc_id, id, id from given""", recursive=True)  # fmt: skip
def plan_given(spark, sf):
    c = orders_corpus(spark, sf)
    out = reports.plan(c, given=c.statements.filter(F.col("ord") % 7 == 0).select("doc_id", "id"), report=False)
    return out.filter(F.size("given") > 0).select("doc_id", "statement", _sorted("given").alias("given"))


@_query("""+ steps as (select distinct p.part as src, c.part as dst from incidence p join incidence c on p.arg = c.arg where p.side = 'p' and c.side = 'c'),
far(part, n) as (select part, 0::bigint from props union select s.dst, f.n + 1 from far f join steps s on s.src = f.part)
select max(n) as longest_chain from far""", base=LAYERS_SQL, recursive=True)  # fmt: skip
def longest_chain(spark, sf):
    return reports.longest_chains(layers_corpus(spark, sf)).select("longest_chain")


@_query(_UP + """, n as (select doc_id, src as id, count(*) as n from up group by 1, 2),
ranked as (select n.doc_id, n.id, n.n, row_number() over (partition by n.doc_id order by n.n desc, s.ord) as rank from n join statements s on s.doc_id = n.doc_id and s.id = n.id)
select doc_id, rank, id, n from ranked where rank <= 5""", recursive=True)  # fmt: skip
def top_supported(spark, sf):
    return reports.top_supporting(orders_corpus(spark, sf), up=True)


_GROUNDED = ORACLE_SQL["well_founded"].split("select s.doc_id, s.id, f.id is not null")[0]


def _after(sql: str) -> str:
    """SQL that goes on after the well-founded CTEs, whose last one is ``last``."""
    return f"{_GROUNDED.rstrip()}\n{sql}"


@_query("", base="")
def grounded_by_joins(spark, sf):
    return graph.grounded_by_joins(orders_corpus(spark, sf))


ORACLE_SQL["grounded_by_joins"] = _after("select s.doc_id, s.id from statements s join last l on l.doc_id = s.doc_id where list_contains(l.done, s.id)")


@_query("", base="")
def filter_ungrounded(spark, sf):
    return editing.filter_statements(orders_corpus(spark, sf), ungrounded_only=True).select("doc_id", "id", "text")


ORACLE_SQL["filter_ungrounded"] = _after("select s.doc_id, s.id, s.text from statements s join last l on l.doc_id = s.doc_id where not list_contains(l.done, s.id)")


@_query("", base="")
def stats_ungrounded(spark, sf):
    return reports.stats(orders_corpus(spark, sf)).select("doc_id", "unused", "ungrounded", "zero_premise_arguments")


ORACLE_SQL["stats_ungrounded"] = _after("""select s.doc_id, 0::bigint as unused, count(*) filter (not list_contains(l.done, s.id)) as ungrounded,
  (select count(*) from (select i.aid from incidence i where i.doc_id = s.doc_id group by i.aid having count(*) filter (side = 'p') = 0)) as zero_premise_arguments
from statements s join last l on l.doc_id = s.doc_id group by s.doc_id""")


@_query(_SCC + " select s.doc_id, s.id, coalesce(r.comp, s.id) as comp from statements s left join ring r on r.doc_id = s.doc_id and r.id = s.id", recursive=True)
def components_by_joins(spark, sf):
    c = orders_corpus(spark, sf)
    return graph.components_by_joins(c.edges, c.statements.select("doc_id", "id"))


@_query(_SCC + " select s.doc_id, s.id from statements s join ring r on r.doc_id = s.doc_id and r.id = s.id", recursive=True)
def filter_cyclic(spark, sf):
    return editing.filter_statements(orders_corpus(spark, sf), cyclic_only=True).select("doc_id", "id")


@_query("select doc_id, id from statements s where mode = 'is' and not exists (select 1 from incidence i where i.doc_id = s.doc_id and i.sid = s.id and side = 'c')")
def filter_foundations(spark, sf):
    return editing.filter_statements(orders_corpus(spark, sf), mode="is", foundations_only=True).select("doc_id", "id")


@_query("""+ ends as (select doc_id, aid, bool_and(mode = 'is') as inside from incidence i join statements s using (doc_id) where s.id = i.sid group by 1, 2)
select doc_id, aid as id from ends where inside""")  # fmt: skip
def drawable_arguments(spark, sf):
    c = orders_corpus(spark, sf)
    return editing.drawable(c, c.statements.filter("mode = 'is'")).arguments.select("doc_id", "id")


# Identities by the kernel, and on cycles.


@_query("+" + _layered_sql() + " select 'p' || part as id, prop as prop_id, just as just_id from just", base=LAYERS_SQL)
def kernel_just_ids(spark, sf):
    return identity.statement_ids(layers_corpus(spark, sf)).select("id", "prop_id", "just_id")


@_query("+" + _layered_sql() + " select 'a' || arg as id, arg_hash from hashes", base=LAYERS_SQL)
def kernel_arg_hashes(spark, sf):
    return identity.argument_hashes(layers_corpus(spark, sf)).select("id", "arg_hash")


def rings_corpus(spark, sf) -> Corpus:
    """A document for each order: customer c gives priority p, p and segment k give each other, and k gives status s."""
    rows = _table(spark, sf, "orders").join(_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), "c_name", "o_orderpriority", "c_mktsegment", "o_orderstatus")
    rows = cut(rows)
    said = [("c", "c_name", "is"), ("p", "o_orderpriority", "is"), ("k", "c_mktsegment", "ought"), ("s", "o_orderstatus", "is")]
    null = {c: _null() for c in ("meta_json", "ext_json")}
    s = rows.select("doc_id", F.posexplode(F.array(*(F.struct(F.lit(i).alias("id"), F.col(c).alias("text"), F.lit(m).alias("mode")) for i, c, m in said))).alias("ord", "s"))
    given = [("cp", "c", "p"), ("pk", "p", "k"), ("kp", "k", "p"), ("ks", "k", "s")]
    a = rows.select("doc_id", F.posexplode(F.array(*(F.struct(F.lit(i).alias("id"), F.array(F.lit(x)).alias("premises"), F.array(F.lit(y)).alias("conclusions"), F.lit(i).alias("justification")) for i, x, y in given))).alias("ord", "a"))
    docs = rows.select("doc_id", _null().alias("source"), F.lit("0.1").alias("version"), F.lit("ring").alias("name"), _null().alias("description")).withColumns(null)
    return Corpus(docs, s.select("doc_id", "ord", "s.*").withColumns(null), a.select("doc_id", "ord", "a.*", _null().alias("rule")).withColumns(null))


def _h(head: str, *parts: str) -> str:
    """SQL of the hash of netstrings; a part that begins with # is a list of one or two hashes, in order."""
    coded = [f"'{len(head)}:{head},'"]
    for p in parts:
        if p.startswith("#"):
            items = p[1:].split("|")
            coded.append(f"'2:#{len(items)},64:' || " + " || ',64:' || ".join(items) + " || ','")
        else:
            coded.append(p if p.startswith("'") else f"strlen({p}) || ':' || {p} || ','")
    return f"sha256({' || '.join(coded)})"


def _arg(why: str, premise: str, conclusion: str) -> str:
    return _h("arg", f"'2:{why},'", f"#{premise}", f"#{conclusion}")


RINGS_SQL = f"""
raw as (select o_orderkey as doc_id, c_name as c, trim(o_orderpriority) as p, trim(c_mktsegment) as k, o_orderstatus as s from orders join customer on c_custkey = o_custkey),
props as (select doc_id, {_h("prop", "c", "'2:is,'")} as pc, {_h("prop", "p", "'2:is,'")} as pp, {_h("prop", "k", "'5:ought,'")} as pk, {_h("prop", "s", "'2:is,'")} as ps from raw),
first as (select *, sha256('4:just,64:' || pc || ',2:#0,') as jc from props),
inner_ as (select *, {_arg("cp", "jc", "pp")} as icp, {_arg("pk", "pp", "pk")} as ipk, {_arg("kp", "pk", "pp")} as ikp from first),
scc as (select *, sha256('3:scc,2:#2,64:' || least(pp, pk) || ',64:' || greatest(pp, pk) || ',2:#3,' || array_to_string(list_transform(list_sort([icp, ipk, ikp]), lambda x: '64:' || x || ','), '')) as scc from inner_),
ring as (select *, {_h("justscc", "scc", "pp")} as jp, {_h("justscc", "scc", "pk")} as jk from scc),
done as (select *, {_arg("cp", "jc", "pp")} as acp, {_arg("pk", "jp", "pk")} as apk, {_arg("kp", "jk", "pp")} as akp, {_arg("ks", "jk", "ps")} as aks from ring),
ids as (select *, {_h("just", "ps", "#aks")} as js from done)
"""


@_query("select doc_id, unnest(['c', 'p', 'k', 's']) as id, unnest([jc, jp, jk, js]) as just_id, unnest([null, scc, scc, null]) as scc from ids", base=RINGS_SQL)
def cyclic_just_ids(spark, sf):
    return identity.statement_ids(rings_corpus(spark, sf)).select("doc_id", "id", "just_id", "scc")


@_query("select doc_id, unnest(['cp', 'pk', 'kp', 'ks']) as id, unnest([acp, apk, akp, aks]) as arg_hash from ids", base=RINGS_SQL)
def cyclic_arg_hashes(spark, sf):
    return identity.argument_hashes(rings_corpus(spark, sf)).select("doc_id", "id", "arg_hash")


# Differences.

_ARG_DIFF = _DIFF.split("ra as (select part")[0] + """ha as (select arg, arg_hash, row_number() over (partition by arg_hash order by arg) as n from hashes),
hb as (select arg, arg_hash, row_number() over (partition by arg_hash order by arg) as n from hashes2)
select case when b.arg is null then 'removed' when a.arg is null then 'added' else 'identical' end as status, 'a' || a.arg as id_a, 'a' || b.arg as id_b from ha a full join hb b using (arg_hash, n)"""


@_query(_ARG_DIFF, base=LAYERS_SQL)
def diff_arguments(spark, sf):
    a = layers_corpus(spark, sf)
    return versions.diff_arguments(a, _layers_edited(a)).select("status", "id_a", "id_b")


@_query(_DIFF.replace("select 'identical' as status", "select status, count(*) as n from (select 'identical' as status") + ") group by 1", base=LAYERS_SQL)
def diff_summary(spark, sf):
    a = layers_corpus(spark, sf)
    return versions.diff_summary(versions.diff_statements(a, _layers_edited(a))).select("status", "n")


@_query(_DIFF.split("select 'identical' as status")[0] + "select 'p' || a as id_a, 'p' || b as id_b, (row_number() over (order by lead_, n) - 1) as place from (select s.a, s.b, r.n, min(r.part) over (partition by r.just) as lead_ from ra r join same s on r.part = s.a)", base=LAYERS_SQL)
def diff_order(spark, sf):
    """Identical statements in the order of a report: by the place where their id first stands, then their own."""
    from pyspark.sql import Window

    a = layers_corpus(spark, sf)
    rows = versions.diff_statements(a, _layers_edited(a)).filter("status = 'identical'")
    return rows.select("id_a", "id_b", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "rank")) - 1).cast("long").alias("place"))


# Merges.

_ARG_MERGE = """+ b as (select doc_id, id, ord, trim(justification) as k from arguments), o as (select doc_id, id, ord, case when ord % 5 = 1 then trim(justification || ' (ours)') else trim(justification) end as k from arguments),
t as (select b.* from b where not exists (select 1 from incidence i where i.doc_id = b.doc_id and i.aid = b.id and i.slot = 11)),
j as (select b.doc_id, b.id, b.k as kb, o.k as ko, t.k as kt from b join o using (doc_id, id) left join t using (doc_id, id)),
c as (select *, ko is distinct from kt and ko is distinct from kb and kt is distinct from kb as conflict,
  case when ko is not distinct from kt then ko when ko is not distinct from kb then kt when kt is not distinct from kb then ko else coalesce(ko, kt) end as k from j)
"""


@_query(_ARG_MERGE + "select doc_id, id, k as justification, conflict from c where k is not null")
def merge_arguments(spark, sf):
    c = orders_corpus(spark, sf)
    _, a = versions.merge_items(c, *_sides(c), plain=True)
    return a.filter("chosen is not null").select("doc_id", "id", texts.collapse(F.col("row.justification")).alias("justification"), "conflict")


@_query(_MERGE + "select doc_id, id, row_number() over (partition by doc_id order by coalesce(b.ord, 0)) - 1 as ord from c join b using (doc_id, id) where c.k is not null")
def merge_order(spark, sf):
    c = orders_corpus(spark, sf)
    merged, _ = versions.merge(c, *_sides(c), plain=True)
    return merged.statements.select("doc_id", "id", F.col("ord").cast("long").alias("ord"))


def _described(c: Corpus, every: int, text: str) -> Corpus:
    return replace(c, docs=c.docs.withColumn("description", F.when(F.col("doc_id") % every == 0, F.lit(text)).otherwise(F.col("description"))))


@_query("""+ d as (select distinct doc_id from statements)
select doc_id, case when doc_id % 3 = 0 then 'ours' when doc_id % 2 = 0 then 'theirs' end as description, doc_id % 6 = 0 as conflict from d""")
def merge_headers(spark, sf):
    c = orders_corpus(spark, sf)
    merged, clashes = versions.merge(c, _described(c, 3, "ours"), _described(c, 2, "theirs"), plain=True)
    heads = clashes.filter("kind = 'header'").select("doc_id", F.lit(True).alias("clash"))
    return merged.docs.join(heads, "doc_id", "left").select("doc_id", "description", F.coalesce("clash", F.lit(False)).alias("conflict"))


def _with_meta(c: Corpus, on, meta: str) -> Corpus:
    text = F.concat(F.lit(meta.split("#")[0]), F.col("ord").cast("string"), F.lit(meta.split("#")[1]))
    return replace(c, statements=c.statements.withColumn("meta_json", F.when(on, text).otherwise(F.col("meta_json"))))


@_query("""select doc_id, id, case when ord % 4 = 0 then '{"x": 1, "n": ' || ord || '}' when ord % 6 = 0 then '{"n": ' || ord || '.0, "x": true}' else '{"n": ' || ord || '}' end as meta,
  false as conflict from statements""")
def merge_meta(spark, sf):
    """Metas that differ in the order of keys, or in true, 1 and 1.0, are equal."""
    c = _with_meta(orders_corpus(spark, sf).written(), F.lit(True), '{"n": #}')
    ours = _with_meta(c, F.col("ord") % 4 == 0, '{"x": 1, "n": #}')
    theirs = _with_meta(c, F.col("ord") % 6 == 0, '{"n": #.0, "x": true}')
    s, _ = versions.merge_items(c, ours, theirs)
    return s.select("doc_id", "id", F.col("row.meta_json").alias("meta"), "conflict")


@_query("""+ touch as (select i.doc_id, i.aid, row_number() over (partition by i.doc_id, i.aid order by side desc, i.slot) as pos, i.slot from incidence i)
select doc_id, aid as id, string_agg('s11', ',') as missing from touch t where slot = 11 and substr(aid, 2)::bigint % 5 = 1 group by 1, 2""")
def merge_dangling(spark, sf):
    c = orders_corpus(spark, sf).written()
    return versions.dangling(*versions.merge_items(c, *_sides(c), plain=True)).select("doc_id", "id", _joined("missing").alias("missing"))


# Documents as JSON: parsing, problems, writing.


def _raw_json(spark, sf) -> DataFrame:
    """(doc_id, json): a document for each customer, with faults by the customer's number."""
    key = F.col("c_custkey")
    mode = F.when(key % 5 == 0, "maybe").otherwise("is")
    extra = F.when(key % 7 == 0, ', "note": 1').otherwise("")
    version = F.when(key % 11 == 0, "1").otherwise("0.1")
    premise = F.when(key % 3 == 0, "ghost").otherwise("s")
    parts = ['{"format": "', documents.FORMAT, '", "version": "', version, '", "name": "', F.col("c_name"), '", "statements": [{"id": "s", "text": "', F.col("c_mktsegment"), '", "mode": "', mode, '"', extra,
             '}, {"id": "t", "text": "T", "mode": "ought"}], "arguments": [{"id": "a", "premises": ["', premise, '"], "conclusions": ["t"], "justification": "j"}]}']
    return _table(spark, sf, "customer").select(key.alias("doc_id"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("json"))


_FAULTS = """with p as (select c_custkey as k, case when c_custkey % 11 = 0 then ['document: ''version'' must be a string like "0.1", got ''1'''] else [] end
  || case when c_custkey % 7 = 0 then ['statements[0]: unknown field ''note'' (extensions belong under ''ext'')'] else [] end
  || case when c_custkey % 5 = 0 then ['statements[0] (s): ''mode'' must be "is" or "ought", got ''maybe'''] else [] end as found from customer),
q as (select k, case when len(found) = 0 and k % 3 = 0 then ['arguments[0] (a): premises references unknown statement ''ghost'''] else found end as found from p)"""


@_query(_FAULTS + " select k::varchar as doc_id, i - 1 as seq, found[i] as message from q, unnest(range(1, len(found) + 1)) as u(i)", base="")
def validation_problems(spark, sf):
    return documents.parse(_raw_json(spark, sf)).problems.select("doc_id", F.col("seq").cast("long").alias("seq"), "message")


@_query(_FAULTS + """ select k::varchar as doc_id, sha256('{"format": "' || '%s' || '", "version": "0.1", "name": "' || c_name || '", "statements": [{"id": "s", "text": "' || c_mktsegment || '", "mode": "is"}, {"id": "t", "text": "T", "mode": "ought"}], "arguments": [{"id": "a", "premises": ["s"], "conclusions": ["t"], "justification": "j"}]}') as sha
from q join customer on c_custkey = k where len(found) = 0""" % documents.FORMAT, base="")  # fmt: skip
def written_documents(spark, sf):
    """Sound documents are written as they were read."""
    return documents.to_json(documents.parse(_raw_json(spark, sf)), None).select("doc_id", F.sha2("json", 256).alias("sha"))


@_query(_FAULTS + """ select k::varchar as doc_id, 's' as id from customer join q on k = c_custkey where k % 5 <> 0 and k % 7 <> 0
union all select k::varchar, 't' from q""", base="")  # fmt: skip
def permissive_statements(spark, sf):
    """What is sound of every document."""
    return documents.parse(_raw_json(spark, sf), permissive=True).statements.select("doc_id", "id")


# Edits.


@_query("""+ n as (select doc_id, max(ord) as last from statements group by 1)
select doc_id, ord, id, text from statements union all select doc_id, last + 1, 'new', 'Added' from n""")
def add_statements(spark, sf):
    c = orders_corpus(spark, sf)
    new = c.docs.select("doc_id", F.explode(F.array(F.lit("new"), F.lit("s3"))).alias("id"), F.lit("Added").alias("text"), F.lit("is").alias("mode"))
    new = new.join(c.statements.select("doc_id", "id"), ["doc_id", "id"], "left_anti").filter("id = 'new'").unionByName(c.statements.filter("id = 's3'").select("doc_id", "id", F.lit("Added").alias("text"), "mode"))
    return editing.add_statements(c, new).statements.select("doc_id", "ord", "id", "text")


@_query("select doc_id, id, case when ord % 4 = 1 then 'Changed' else text end as text, case when ord % 8 = 1 then 'is' else mode end as mode from statements")
def update_statements(spark, sf):
    c = orders_corpus(spark, sf)
    changes = c.statements.filter(F.col("ord") % 4 == 1).select("doc_id", "id", F.lit("Changed").alias("text"), F.when(F.col("ord") % 8 == 1, "is").alias("mode"))
    return editing.update(c.statements, changes, ["text", "mode"]).select("doc_id", "id", "text", "mode")


@_query("""+ named as (select *, case when slot % 6 = 2 then 'r' || slot else sid end as nid from incidence)
select doc_id, aid as id, coalesce(string_agg(nid, ',' order by slot) filter (side = 'p'), '') as premises, string_agg(nid, ',' order by slot) filter (side = 'c') as conclusions from named group by 1, 2""")
def rename_statements(spark, sf):
    c = orders_corpus(spark, sf)
    names = c.statements.filter(F.col("ord") % 6 == 2).select("doc_id", "id", F.concat(F.lit("r"), F.col("ord").cast("string")).alias("new_id"))
    return editing.rename_statements(c, names).arguments.select("doc_id", "id", _joined("premises").alias("premises"), _joined("conclusions").alias("conclusions"))


@_query("""+ placed as (select *, row_number() over (partition by doc_id order by ord) - 1 as pos, max(ord) over (partition by doc_id) as most from statements)
select doc_id, id, case when ord = most then 0 else pos + 1 end as ord from placed""")
def move_statements(spark, sf):
    """The last statement of each document goes first."""
    c = orders_corpus(spark, sf)
    last = c.statements.groupBy("doc_id").agg(F.max_by("id", "ord").alias("id")).withColumn("to", F.lit(0))
    return editing.move(c.statements, last).select("doc_id", "id", F.col("ord").cast("long").alias("ord"))


@_query("select doc_id, case when doc_id % 2 = 0 then 'Title' else 'customer ' || doc_id end as name from (select distinct doc_id from statements)")
def set_header(spark, sf):
    c = orders_corpus(spark, sf)
    changes = c.docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Title").alias("name"))
    return editing.set_header(c, changes, ["name"]).docs.select("doc_id", "name")


@_query("select doc_id, 's' || (max(ord) + 1) as id from statements group by 1")
def fresh_ids(spark, sf):
    return editing.fresh_ids(orders_corpus(spark, sf).statements, "s")


# Texts.

_FLAT = "trim(regexp_replace(coalesce(text, ''), '[\\s\\x{feff}\\x{a0}\\p{Zs}\\x{2028}\\x{2029}]+', ' ', 'g'))"


@_query(f"select doc_id, case when length(t) > 80 then substr(t, 1, 79) || '…' else t end as short from (select doc_id, {_FLAT} as t from documents)", base="")
def ellipses(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", texts.ellipsis(F.coalesce("text", F.lit(""))).alias("short"))


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


@_query(f"select p_partkey as id, case when length(s) > 48 then coalesce(nullif(regexp_extract(substr(s, 1, 49), '^(.*)-[^-]*$', 1), ''), substr(s, 1, 48)) else s end as slug from (select p_partkey, {_SLUG.format("p_name || ' / ' || p_type || ' / ' || p_brand")} as s from part)", base="")
def slugs(spark, sf):
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), texts.slugify(F.concat_ws(" / ", "p_name", "p_type", "p_brand")).alias("slug"))


@_query("select p_partkey as id, regexp_matches(p_name, '\\s') as name, regexp_matches(p_brand, '\\s') as brand from part" , base="")
def whitespace_in_ids(spark, sf):
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), texts.has_whitespace(F.col("p_name")).alias("name"), texts.has_whitespace(F.col("p_brand")).alias("brand"))


@_query(f"""select doc_id, seq, case when n = 1 then slug else slug || '-' || n end as id from (
  select p_brand as doc_id, p_partkey as seq, {_SLUG.format("p_type")} as slug, row_number() over (partition by p_brand, {_SLUG.format("p_type")} order by p_partkey) as n from part)""", base="")
def assigned_ids(spark, sf):
    rows = _table(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").cast("long").alias("seq"), F.col("p_name").alias("text"), F.col("p_type").alias("slug"))
    return extraction.assign_ids(rows).select("doc_id", "seq", "id")


# Extraction.


def _tagged(spark, sf) -> DataFrame:
    """A tagged text for each customer: orders under headings of their status, with stray lines between."""
    o = _table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    line = F.concat(F.lit("# Status "), "o_orderstatus", F.lit("\n[o"), F.col("o_orderkey").cast("string"), F.lit("]  Priority\t is\n"), "o_orderpriority", F.lit(" \n\n"), F.when(F.col("o_orderkey") % 3 == 0, "stray\n\n").otherwise(""))
    return o.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line"))))["line"], "").alias("text"))


_TAGGED = """with o as (select o_custkey as doc_id, o_orderkey as k, o_orderstatus as st, o_orderpriority as pr, count(*) over (partition by o_custkey) as n, count(*) filter (o_orderkey % 3 = 0) over (partition by o_custkey) as stray,
  row_number() over (partition by o_custkey order by o_orderkey) as nth, coalesce(count(*) filter (o_orderkey % 3 = 0) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as before from orders),
t as (select *, n >= 2 as tagged from o)"""


@_query(_TAGGED + """ select doc_id, nth - 1 as idx, 'o' || k as key, 'Priority' || chr(9) || ' is ' || trim(pr) as text, 'Status ' || st as heading from t where tagged
union all select doc_id, nth - 1 + before, 'p' || (nth + before), '[o' || k || ']  Priority' || chr(9) || ' is ' || trim(pr), 'Status ' || st from t where not tagged
union all select doc_id, nth + before, 'p' || (nth + before + 1), 'stray', 'Status ' || st from t where not tagged and k % 3 = 0""", base="")  # fmt: skip
def tagged_paragraphs(spark, sf):
    return extraction.paragraphs(_tagged(spark, sf)).select("doc_id", F.col("idx").cast("long").alias("idx"), "key", "text", "heading")


@_query(_TAGGED + " select distinct doc_id, case when tagged then 'tagged' else 'untagged' end as mode, case when tagged then n else n + stray end as paragraphs, case when tagged then stray else 0 end as skipped from t", base="")
def segmentations(spark, sf):
    out = extraction.segmentation(_tagged(spark, sf))
    return out.select("doc_id", "mode", F.col("paragraphs").cast("long").alias("paragraphs"), F.col("skipped").cast("long").alias("skipped"))


_PACKED = f"""with recursive {_LINES},
sized as (select doc_id, n, greatest(1, ceil(length(line) / 3.5))::bigint as t from paras),
pack(doc_id, n, t, chunk, used) as (select doc_id, n, t, 0::bigint, t from sized where n = 1
  union all select s.doc_id, s.n, s.t, case when p.used + s.t > 600 then p.chunk + 1 else p.chunk end, case when p.used + s.t > 600 then s.t else p.used + s.t end
  from pack p join sized s on s.doc_id = p.doc_id and s.n = p.n + 1)"""


@_query(_PACKED + " select doc_id, 'p' || min(n) as key, sum(t)::bigint as tokens from pack group by doc_id, chunk having count(*) = 1 and sum(t) > 600", base="")
def oversize_chunks(spark, sf):
    packed = extraction.chunks(extraction.paragraphs(_table(spark, sf, "documents")), 600)
    return extraction.oversize(packed, 600)


@_query(_PACKED + """, c as (select doc_id, count(*) as paragraphs, max(chunk) + 1 as chunks, sum(t)::bigint as tokens from pack group by 1)
select d.doc_id, coalesce(paragraphs, 0) as paragraphs, coalesce(chunks, 0) as chunks, coalesce(tokens, 0) as tokens from documents d left join c using (doc_id)""", base="")  # fmt: skip
def dry_runs(spark, sf):
    return extraction.dry_run(_table(spark, sf, "documents"), 600).select("doc_id", F.col("paragraphs").cast("long").alias("paragraphs"), "chunks", "tokens")


def _replies(spark, sf) -> DataFrame:
    """Each turn of a conversation as the reply to a chunk, with one candidate statement."""
    one = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit("is").alias("mode"), F.array(F.concat(F.lit("[t"), F.col("turn").cast("string"), F.lit("]")), F.lit("zz")).alias("sources"), F.col("role"), F.lit(" ").alias("note"), F.lit("x").alias("slug"))
    return _table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), F.to_json(F.struct(F.array(one).alias("statements"))).alias("response"))


@_query("""with c as (select conv_id as doc_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as text from conversations)
select doc_id, row_number() over (partition by doc_id order by turn) - 1 as seq, text, role, 't' || turn as source from c where text <> ''""", base="")
def reply_candidates(spark, sf):
    keys = _table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("key"))
    return extraction.candidates(_replies(spark, sf), keys).select("doc_id", "seq", "text", "role", _joined("sources").alias("source"))


@_query("""+ first as (select doc_id, canon, mode, min(ord) as keep from statements group by 1, 2, 3)
select s.doc_id, s.id as dropped, 's' || keep as kept from statements s join first f on f.doc_id = s.doc_id and f.canon = s.canon and f.mode = s.mode where s.ord <> keep""")
def merge_mapping(spark, sf):
    """Every statement is proposed for the one before it of its proposition, so that the merges form chains."""
    from pyspark.sql import Window

    s = orders_corpus(spark, sf).statements.withColumn("prop", texts.prop_id(F.col("text"), F.col("mode"))).withColumn("batch", F.lit(0))
    before = F.lag("id").over(Window.partitionBy("doc_id", "prop").orderBy("ord"))
    asked = s.withColumn("keep", before).filter("keep is not null").select("doc_id", F.col("ord").alias("seq"), "batch", "keep", F.array("id").alias("drop"))
    return extraction.merge_mapping(s, asked)


@_query("""+ many as (select doc_id, count(*) > 12 as many from statements group by 1), c as (select doc_id, unnest(range(0, 9)) as chunk from many),
near as (select c.doc_id, chunk, s.id from c join statements s on s.doc_id = c.doc_id and abs(s.ord % 5 - chunk) <= 1)
select c.doc_id, chunk::integer as chunk, s.id from c join many using (doc_id) join statements s on s.doc_id = c.doc_id
where not many or not exists (select 1 from near n where n.doc_id = c.doc_id and n.chunk = c.chunk) or abs(s.ord % 5 - chunk) <= 1""")
def visible_statements(spark, sf):
    c = orders_corpus(spark, sf)
    s = c.statements.select("doc_id", "id", F.array((F.col("ord") % 5).cast("int")).alias("chunks"))
    return extraction.visible(s, c.docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("chunk")), 12)


@_query("""+ r as (select doc_id, arg_key, side, slot, case when slot % 10 = 4 then 's' || (slot - 4) when slot % 10 = 7 then null else sid end as "to" from incidence),
live as (select r.* from r left join statements s on s.doc_id = r.doc_id and s.id = r."to" where s.id is not null and s.ord % 10 not in (4, 7)),
args as (select doc_id, arg_key, coalesce(list_sort(list(distinct "to") filter (side = 'p')), []) as ps, list_sort(list(distinct "to") filter (side = 'c')) as cs from live group by 1, 2),
uniq as (select *, row_number() over (partition by doc_id, ps, cs order by arg_key) as n from args where cs is not null)
select doc_id, 'a' || arg_key as id, array_to_string(ps, ',') as premises, array_to_string(cs, ',') as conclusions from uniq where n = 1""")
def repaired_arguments(spark, sf):
    """Slots 4, 14, ... were merged into those four below, 7, 17, ... are unknown, and every third reference is only spelt alike."""
    c = orders_corpus(spark, sf)
    s = c.statements.filter((F.col("ord") % 10 != 4) & (F.col("ord") % 10 != 7))
    merged = c.statements.filter(F.col("ord") % 10 == 4).select("doc_id", F.col("id").alias("dropped"), F.concat(F.lit("s"), (F.col("ord") - 4).cast("string")).alias("kept"))
    spelt = lambda c: F.transform(c, lambda x, i: F.when(i % 3 == 2, F.concat(F.upper(x), F.lit("!"))).otherwise(x))
    a = c.arguments.withColumns({k: spelt(k) for k in ("premises", "conclusions")})
    out, _ = extraction.repaired(s, a, merged)
    return out.select("doc_id", "id", _sorted("premises").alias("premises"), _sorted("conclusions").alias("conclusions"))


@_query("select role as model, count(*) as calls, sum(turn)::bigint as input_tokens, sum(length(coalesce(text, '')))::bigint as output_tokens from conversations group by 1", base="")
def reply_usage(spark, sf):
    rows = _table(spark, sf, "conversations").select(F.col("role").alias("model"), F.struct(F.col("turn").cast("long").alias("input_tokens"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("output_tokens")).alias("usage"))
    return extraction.usage(rows)


_SYSTEM, _SCHEMA = "Answer in JSON.", {"type": "object"}


@_query("""+ u as (select doc_id, 'Document: customer ' || doc_id || chr(10) || chr(10) || 'Candidate statements (id [mode]: text):' || chr(10) || string_agg(id || ' [' || mode || ']: ' || text, chr(10) order by ord) || chr(10) || chr(10) || 'Propose merges of near-duplicate statements, or an empty list.' as u from statements group by 1)
select doc_id, sha256(u) as prompt, sha256('{"schema": {"type": "object"}, "system": "Answer in JSON.", "user": "' || replace(replace(u, '"', '\\"'), chr(10), '\\n') || '"}') as request_hash from u""")
def merge_requests(spark, sf):
    c = orders_corpus(spark, sf)
    rows = c.statements.withColumn("batch", F.lit(0)).withColumn("seq", F.col("ord"))
    asked = prompts.with_hash(prompts.merge_prompts(rows, F.concat(F.lit("customer "), F.col("doc_id").cast("string"))), _SYSTEM, _SCHEMA)
    return asked.select("doc_id", F.sha2("user", 256).alias("prompt"), "request_hash")


@_query("select conv_id as doc_id, turn::integer as call_index, turn % 4 <> 1 and turn % 5 <> 2 as agrees, turn % 5 = 2 as missing from conversations", base="")
def replayed(spark, sf):
    """Replies are found by their index; some are missing, some were recorded for another request."""
    turns = _table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("call_index"), "role")
    asked = turns.select("doc_id", "call_index", F.concat("role", F.col("call_index").cast("string")).alias("request_hash"))
    hashed = F.when(F.col("call_index") % 4 == 1, "other").when(F.col("call_index") % 3 == 0, None).otherwise(F.concat("role", F.col("call_index").cast("string")))
    replies = turns.filter(F.col("call_index") % 5 != 2).select("doc_id", "call_index", hashed.alias("request_hash"), F.lit("{}").alias("response"))
    return extraction.replay(asked, replies).select("doc_id", "call_index", "agrees", "missing")


# Rendering.

_DOT_LINES = _DOT_SQL.format(node="""' [shape=box, style=rounded, label="' || id || '\\n' || text || '"' || case when mode = 'ought' then ', peripheries=2' else '' end || '];'""",
    hub="""' [shape=diamond, fontsize=8, label="' || id || case when rule is not null then '\\n' || rule else '' end || '"];'""", arrow=" -> ", end=";")


@_query(f"""+ body as ({_DOT_LINES})
select doc_id, sha256({" || chr(10) || ".join("'" + h.replace("{}", "LR") + "'" for h in rendering.DOT_HEAD)} || chr(10) || '  label="customer ' || doc_id || '"; labelloc=t;' || chr(10) || string_agg(line, chr(10) order by section, ord, pos) || chr(10) || '}}' || chr(10)) as sha from body group by 1""")
def dot_documents(spark, sf):
    return rendering.to_dot(orders_corpus(spark, sf).written()).select("doc_id", F.sha2("text", 256).alias("sha"))


@_query("""+ f as (select s.* from statements s where not exists (select 1 from incidence i where i.doc_id = s.doc_id and i.sid = s.id and side = 'c'))
select doc_id, id as statement, '# ' || canon || chr(10) || chr(10) || '`' || id || '` · ' || mode || chr(10) || chr(10) || '## The case' || chr(10) || chr(10) || '- **' || canon || '** (`' || id || '`, ' || mode || ') — *foundation*'
  || chr(10) || chr(10) || '## Foundations reached' || chr(10) || chr(10) || '- `' || id || '`: ' || canon || chr(10) as text from f""")
def present_foundations(spark, sf):
    c = orders_corpus(spark, sf)
    return rendering.present(c, graph.foundations(c).select("doc_id", "id"))


@_query("""with b as (select page_id, html from pages)
select page_id as doc_id, len(regexp_extract_all(html, '(?i)<h[123][^>]*>[^<]*[^<\\s][^<]*</h[123]>')) as headings from b""", base="")
def page_headings(spark, sf):
    """How many headings with text every page has."""
    table = _table(spark, sf, "pages")
    counted = pages.tagged_blocks(table).groupBy("doc_id").agg(F.count_if(F.col("tag").startswith("h")).alias("headings"))
    return table.select(F.col("page_id").alias("doc_id")).join(counted, "doc_id", "left").select("doc_id", F.coalesce("headings", F.lit(0)).cast("long").alias("headings"))
