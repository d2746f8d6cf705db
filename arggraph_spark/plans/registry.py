"""Queries of the engine's operators over the test tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators import editing, extraction, graph, identity, rendering, reports, versions
from ..operators.fixpoint import cut
from ..sources import documents
from ..sources.corpus import Corpus
from ..sources.mapping import LAYERS_SQL, ORDERS_SQL, layers_corpus, orders_corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None, base: str = ORDERS_SQL, recursive: bool = False):
    """Registers a function (spark, sf_dir) under its name, and SQL that continues the corpus's WITH list."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = f"with {'recursive ' * recursive}{base.strip()}" if base else ""
            ORACLE_SQL[f.__name__] = f"{head}{', ' if base and sql.lstrip().startswith('+') else chr(10)}{sql.lstrip().removeprefix('+')}"
        return f

    return register


def _joined(c):
    return F.array_join(c, ",")


_NET = "strlen({0}) || ':' || {0} || ','"
_PROP = "sha256('4:prop,' || " + _NET.format("canon") + " || " + _NET.format("mode") + ")"


@_query(f"select doc_id, id, text, mode, {_PROP} as prop_id from statements s where not exists (select 1 from incidence i where i.doc_id = s.doc_id and i.sid = s.id and side = 'c')")
def foundations(spark, sf):
    c = orders_corpus(spark, sf)
    from ..functions.text import prop_id

    return graph.foundations(c).select("doc_id", "id", "text", "mode", prop_id(F.col("text"), F.col("mode")).alias("prop_id"))


@_query(f"select doc_id, id, {_PROP} as prop_id from statements")
def prop_ids(spark, sf):
    return identity.prop_ids(orders_corpus(spark, sf)).select("doc_id", "id", "prop_id")


@_query("select doc_id, id from statements s where not exists (select 1 from incidence i where i.doc_id = s.doc_id and i.sid = s.id and side = 'p')")
def terminals(spark, sf):
    return graph.terminals(orders_corpus(spark, sf)).select("doc_id", "id")


def _edited(c: Corpus) -> Corpus:
    """Statement 7 edited, every tenth argument gone."""
    s = c.statements.withColumn("text", F.when(F.col("ord") == 7, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")))
    return replace(c, statements=s, arguments=c.arguments.filter(F.col("ord") % 10 != 0))


@_query("select doc_id, id from statements s where not exists (select 1 from incidence i where i.doc_id = s.doc_id and i.sid = s.id and arg_key % 10 <> 0)")
def unused(spark, sf):
    return reports.unused(_edited(orders_corpus(spark, sf))).select("doc_id", "id")


@_query("select doc_id, id from arguments where trim(justification) = ''")
def empty_justifications(spark, sf):
    return reports.empty_justifications(orders_corpus(spark, sf)).select("doc_id", "id")


@_query("""+ sides as (select i.doc_id, i.aid, i.side, i.slot, i.sid, s.mode from incidence i join statements s on s.doc_id = i.doc_id and s.id = i.sid)
select doc_id, aid as argument, string_agg(sid, ',' order by slot) filter (side = 'c' and mode = 'ought') as ought_conclusions,
  coalesce(string_agg(sid, ',' order by slot) filter (side = 'p'), '') as premises
from sides group by all having bool_or(side = 'c' and mode = 'ought') and not bool_or(side = 'p' and mode = 'ought')""")  # fmt: skip
def is_ought_gaps(spark, sf):
    return reports.is_ought_gaps(orders_corpus(spark, sf)).select("doc_id", "argument", _joined("ought_conclusions").alias("ought_conclusions"), _joined("premises").alias("premises"))


@_query(f"select doc_id, {_PROP} as prop_id, any_value(canon) as text, string_agg(id, ',' order by ord) as ids from statements group by doc_id, canon, mode having count(*) > 1")
def duplicates(spark, sf):
    return reports.duplicates(orders_corpus(spark, sf)).select("doc_id", "prop_id", "text", _joined("ids").alias("ids"))


@_query("select doc_id, src, dst from edges")
def edges(spark, sf):
    return graph.edges(orders_corpus(spark, sf))


@_query("select doc_id, src as id from edges where src = dst")
def self_loops(spark, sf):
    return graph.self_loops(orders_corpus(spark, sf))


_UP = "+ up(doc_id, src, dst) as (select doc_id, dst, src from edges union select u.doc_id, u.src, e.src from up u join edges e on e.doc_id = u.doc_id and e.dst = u.dst)"


@_query(_UP + " select doc_id, src, dst from up", recursive=True)
def upstream_closure(spark, sf):
    return graph.closure_pairs(orders_corpus(spark, sf), up=True)


@_query(_UP + " select doc_id, dst as src, src as dst from up", recursive=True)
def downstream_closure(spark, sf):
    return graph.closure_pairs(orders_corpus(spark, sf), up=False)


@_query(_UP + " select doc_id, src, dst from up", recursive=True)
def upstream_closure_by_joins(spark, sf):
    return graph.closure(orders_corpus(spark, sf).edges, up=True).select("doc_id", "src", "dst")


@_query("""+ hop as (select doc_id, src, dst from edges union select doc_id, dst, src from edges),
near as (select doc_id, id as src, id as dst, 0 as hops from statements
  union all select doc_id, src, dst, 1 from hop
  union all select a.doc_id, a.src, b.dst, 2 from hop a join hop b on a.doc_id = b.doc_id and a.dst = b.src)
select doc_id, src, dst, min(hops)::integer as hops from near group by all""")
def focus(spark, sf):
    c = orders_corpus(spark, sf)
    return graph.focus(c, c.statements.select("doc_id", "id"), 2).select("doc_id", "src", "dst", "hops")


@_query(_UP + """, mine as (select doc_id, src, dst from up union select doc_id, id, id from statements)
select m.doc_id, m.src as statement, string_agg(distinct i.aid, ',' order by i.aid) as arguments
from mine m join incidence i on i.doc_id = m.doc_id and i.sid = m.dst and side = 'c' group by 1, 2""", recursive=True)  # fmt: skip
def closure_arguments(spark, sf):
    out = reports.rests_on(orders_corpus(spark, sf), report=False).filter(F.size("closure_arguments") > 0)
    return out.select("doc_id", "statement", _joined(F.array_sort("closure_arguments")).alias("arguments"))


#: The audience accepts every seventh slot.
_PLAN = """+ given as (select doc_id, id from statements where ord % 7 = 0),
need(doc_id, src, dst) as (select doc_id, id, id from statements union
  select n.doc_id, n.src, e.src from need n join edges e on e.doc_id = n.doc_id and e.dst = n.dst
  where not exists (select 1 from given g where g.doc_id = n.doc_id and g.id = n.dst)),
rest as (select * from need n where not exists (select 1 from given g where g.doc_id = n.doc_id and (g.id = n.dst or g.id = n.src))),
argued as (select distinct doc_id, sid from incidence where side = 'c')
select r.doc_id, r.src as statement, string_agg(r.dst, ',' order by r.dst) as needed from rest r {} join argued a on a.doc_id = r.doc_id and a.sid = r.dst group by 1, 2"""


def _plan(spark, sf, what: str) -> DataFrame:
    c = orders_corpus(spark, sf)
    out = reports.plan(c, given=c.statements.filter(F.col("ord") % 7 == 0).select("doc_id", "id"), report=False)
    return out.filter(F.size(what) > 0).select("doc_id", "statement", _joined(F.array_sort(what)).alias("needed"))


@_query(_PLAN.format("anti"), recursive=True)
def plan_must_grant(spark, sf):
    return _plan(spark, sf, "must_grant")


@_query(_PLAN.format("semi"), recursive=True)
def plan_must_establish(spark, sf):
    return _plan(spark, sf, "must_establish")


_SCC = _UP + """, ring as (select a.doc_id, a.src as id, min(a.dst) as comp, string_agg(a.dst, ',' order by a.dst) as members
  from up a join up b on a.doc_id = b.doc_id and a.src = b.dst and a.dst = b.src group by 1, 2)"""


@_query(_SCC + " select distinct doc_id, comp, members from ring", recursive=True)
def scc_members(spark, sf):
    members = F.array_sort("members")
    return reports.cycles(orders_corpus(spark, sf)).select("doc_id", members[0].alias("comp"), _joined(members).alias("members"))


@_query(_SCC + """, ends as (select distinct doc_id, aid, sid from incidence),
touch as (select r.doc_id, r.comp, e.aid, count(*) as inside from ends e join ring r on r.doc_id = e.doc_id and r.id = e.sid group by 1, 2, 3)
select t.doc_id, comp, t.aid as argument, inside = (select count(*) from ends e where e.doc_id = t.doc_id and e.aid = t.aid) as internal from touch t""", recursive=True)  # fmt: skip
def scc_internal_boundary(spark, sf):
    c = reports.cycles(orders_corpus(spark, sf)).withColumn("comp", F.array_min("members"))
    side = lambda col, inside: c.select("doc_id", "comp", F.explode(col).alias("argument"), F.lit(inside).alias("internal"))
    return side("internal_arguments", True).unionByName(side("boundary_arguments", False))


@_query(_SCC + """, ends as (select distinct doc_id, aid, sid from incidence),
touch as (select r.doc_id, r.comp, e.aid, count(*) as inside from ends e join ring r on r.doc_id = e.doc_id and r.id = e.sid group by 1, 2, 3)
select t.doc_id, comp, t.aid as argument, inside = (select count(*) from ends e where e.doc_id = t.doc_id and e.aid = t.aid) as internal from touch t""", recursive=True)  # fmt: skip
def scc_arguments_by_joins(spark, sf):
    c = orders_corpus(spark, sf)
    comps = cut(graph.components(c).filter("cyclic"))
    least = comps.groupBy("doc_id", "comp").agg(F.min("id").alias("name"))
    return reports.scc_arguments(c, comps).join(least, ["doc_id", "comp"]).select("doc_id", F.col("name").alias("comp"), F.col("arg_id").alias("argument"), "internal")


@_query("""+ need as (select distinct doc_id, aid, sid from incidence where side = 'p'), into_ as (select distinct doc_id, aid, sid from incidence where side = 'c'),
first as (select doc_id, id from statements s where not exists (select 1 from into_ i where i.doc_id = s.doc_id and i.sid = s.id)),
docs as (select doc_id, list(distinct aid) as args from incidence group by 1),
args as (select i.doc_id, i.aid, list(distinct i.sid) filter (side = 'p') as ps, list(distinct i.sid) filter (side = 'c') as cs from incidence i group by 1, 2),
packed as (select doc_id, list({'p': coalesce(ps, []), 'c': cs}) as args from args group by 1),
start as (select p.doc_id, p.args, coalesce((select list(id) from first f where f.doc_id = p.doc_id), []) as done from packed p),
spread(doc_id, args, done, n) as (select doc_id, args, done, 0 from start
  union all select doc_id, args, list_distinct(list_concat(done, flatten(list_transform(list_filter(args, lambda a: len(list_filter(a.p, lambda x: not list_contains(done, x))) = 0), lambda a: a.c)))), n + 1 from spread
  where len(list_filter(args, lambda a: len(list_filter(a.p, lambda x: not list_contains(done, x))) = 0 and len(list_filter(a.c, lambda x: not list_contains(done, x))) > 0)) > 0),
last as (select doc_id, arg_max(done, n) as done from spread group by 1)
select s.doc_id, s.id, f.id is not null as foundation, list_contains(l.done, s.id) as grounded
from statements s join last l on l.doc_id = s.doc_id left join first f on f.doc_id = s.doc_id and f.id = s.id""", recursive=True)  # fmt: skip
def well_founded(spark, sf):
    return graph.well_founded(orders_corpus(spark, sf)).select("doc_id", "id", "foundation", "grounded")


# Identities over layers: unrolled by layer.


def _layered_sql(part_text: str = "p_name", keep: str = "true", tag: str = "") -> str:
    """CTEs just{tag}(part, layer, prop, just) and hashes{tag}(arg, arg_hash) of the layered corpus with edits."""
    t = tag
    nets = "coalesce(string_agg({0}, '' order by {1}), '')"
    out = f""" inc{t} as (select * from incidence where {keep}),
pr{t} as (select part, layer, prop from (select p_partkey as part, p_partkey % 4 as layer, sha256('4:prop,' || strlen(x) || ':' || x || ',' || strlen(m) || ':' || m || ',') as prop
  from (select p_partkey, {part_text} as x, case when p_size % 2 = 0 then 'is' else 'ought' end as m from part) where p_partkey in (select part from incidence))),
why{t} as (select arg, any_value(top) as top, count(*) filter (side = 'c') as nc, count(*) filter (side = 'p') as np, 'order ' || arg as why from inc{t} group by arg),
cs{t} as (select i.arg, {nets.format("'64:' || prop || ','", "prop")} as cs from inc{t} i join pr{t} using (part) where side = 'c' group by 1)"""
    for k in range(4):
        below = " union all ".join(f"select part, just from ju{t}{j}" for j in range(k)) or "select null::bigint as part, null::varchar as just where false"
        out += f""",
be{t}{k} as ({below}),
ps{t}{k} as (select i.arg, {nets.format("'64:' || just || ','", "just")} as ps from inc{t} i join be{t}{k} using (part) where side = 'p' group by 1),
ha{t}{k} as (select w.arg, sha256('3:arg,' || strlen(why) || ':' || why || ',' || strlen('#' || np) || ':#' || np || ',' || coalesce(ps, '') || strlen('#' || nc) || ':#' || nc || ',' || cs) as arg_hash
  from why{t} w join cs{t} using (arg) left join ps{t}{k} using (arg) where top = {k}),
ar{t}{k} as (select i.part, count(*) as n, {nets.format("'64:' || arg_hash || ','", "arg_hash")} as args from inc{t} i join ha{t}{k} using (arg) where side = 'c' group by 1),
ju{t}{k} as (select p.part, p.layer, prop, sha256('4:just,64:' || prop || ',' || strlen('#' || coalesce(n, 0)) || ':#' || coalesce(n, 0) || ',' || coalesce(args, '')) as just from pr{t} p left join ar{t}{k} using (part) where layer = {k})"""
    return out + f",\njust{t} as ({' union all '.join(f'select * from ju{t}{k}' for k in range(4))}), hashes{t} as ({' union all '.join(f'select * from ha{t}{k}' for k in range(4))})"


def _layered(c: Corpus):
    return identity.layered_identities(c, (F.col("ord") % 4).cast("int"), 4)


@_query("+" + _layered_sql() + " select 'p' || part as id, just as just_id from just", base=LAYERS_SQL)
def layered_just_ids(spark, sf):
    return _layered(layers_corpus(spark, sf))[0].select("id", "just_id")


@_query("+" + _layered_sql() + " select 'a' || arg as id, arg_hash from hashes", base=LAYERS_SQL)
def layered_arg_hashes(spark, sf):
    return _layered(layers_corpus(spark, sf))[1].select(F.col("arg").alias("id"), "arg_hash")


def _layers_edited(c: Corpus) -> Corpus:
    s = c.statements.withColumn("text", F.when(F.col("ord") % 70 == 7, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text")))
    return replace(c, statements=s, arguments=c.arguments.filter(F.col("ord") % 10 != 0))


_DIFF = "+" + _layered_sql() + "," + _layered_sql("case when p_partkey % 70 = 7 then p_name || ' (edited)' else p_name end", "arg % 10 <> 0", "2") + """,
ra as (select part, just, prop, row_number() over (partition by just order by part) as n from just),
rb as (select part, just, prop, row_number() over (partition by just order by part) as n from just2),
same as (select a.part as a, b.part as b from ra a join rb b using (just, n)),
la as (select part, prop, row_number() over (partition by prop order by part) as n from just where part not in (select a from same)),
lb as (select part, prop, row_number() over (partition by prop order by part) as n from just2 where part not in (select b from same)),
again as (select a.part as a, b.part as b from la a join lb b using (prop, n))
select 'identical' as status, 'p' || a as id_a, 'p' || b as id_b from same union all select 'rejustified', 'p' || a, 'p' || b from again
union all select 'removed', 'p' || part, null from la where part not in (select a from again) union all select 'added', null, 'p' || part from lb where part not in (select b from again)"""


@_query(_DIFF, base=LAYERS_SQL)
def diff_statements(spark, sf):
    """Identities of both versions in one pass, layer by layer."""
    a = layers_corpus(spark, sf)
    b = _layers_edited(a)
    c = versions.both(a, b)
    just = _layered(c)[0].withColumnRenamed("prop", "prop_id")
    return versions.diff_statements(a, b, *versions.apart(just)).select("status", "id_a", "id_b")


@_query("""+ size as (select doc_id, aid, count(*) filter (side = 'p') as p, count(*) filter (side = 'c') as c from incidence group by 1, 2),
s as (select doc_id, count(*) as statements, count(*) filter (mode = 'is') as mode_is, count(*) filter (mode = 'ought') as mode_ought from statements group by 1),
a as (select doc_id, count(*) as arguments, min(p) as premises_min, max(p) as premises_max, sum(p)::bigint as p, min(c) as conclusions_min, max(c) as conclusions_max, sum(c)::bigint as c, count(*) filter (p = 0) as zero_premise_arguments from size group by 1)
select doc_id, statements, mode_is, mode_ought, arguments, premises_min, premises_max, round_even(p::double / arguments, 3) as premises_mean, conclusions_min, conclusions_max, round_even(c::double / arguments, 3) as conclusions_mean, zero_premise_arguments
from s join a using (doc_id)""")  # fmt: skip
def stats_counts(spark, sf):
    return reports.counts(orders_corpus(spark, sf))


@_query(_SCC + """, ring_count as (select doc_id, count(distinct comp) as cycles, count(*) as inside from ring group by 1),
largest as (select doc_id, max(n) as n from (select doc_id, comp, count(*) as n from ring group by 1, 2) group by 1),
f as (select doc_id, count(*) as n from statements s where not exists (select 1 from incidence i where i.doc_id = s.doc_id and i.sid = s.id and side = 'c') group by 1),
t as (select doc_id, count(*) as n from statements s where not exists (select 1 from incidence i where i.doc_id = s.doc_id and i.sid = s.id and side = 'p') group by 1)
select d.doc_id, coalesce(f.n, 0) as foundations, coalesce(t.n, 0) as terminals, coalesce(cycles, 0) as cycles, coalesce(largest.n, 0) as largest_cycle, coalesce(inside, 0) as statements_in_cycles
from (select distinct doc_id from statements) d left join f using (doc_id) left join t using (doc_id) left join ring_count using (doc_id) left join largest using (doc_id)""", recursive=True)  # fmt: skip
def stats_structure(spark, sf):
    return reports.stats(orders_corpus(spark, sf)).select("doc_id", "foundations", "terminals", "cycles", "largest_cycle", "statements_in_cycles")


@_query(_UP + """, n as (select doc_id, dst as id, count(*) as n from up group by 1, 2),
ranked as (select n.doc_id, n.id, n.n, row_number() over (partition by n.doc_id order by n.n desc, s.ord) as rank from n join statements s on s.doc_id = n.doc_id and s.id = n.id)
select doc_id, rank, id, n from ranked where rank <= 5""", recursive=True)  # fmt: skip
def top_supporting(spark, sf):
    return reports.top_supporting(orders_corpus(spark, sf))


# Merge: two edited copies.


def _sides(c: Corpus) -> tuple[Corpus, Corpus]:
    add = lambda t, col, on, what: t.withColumn(col, F.when(on, F.concat(col, F.lit(what))).otherwise(F.col(col)))
    ours = replace(c, statements=add(c.statements, "text", F.col("ord") % 10 == 3, " (ours)"), arguments=add(c.arguments, "justification", F.col("ord") % 5 == 1, " (ours)"))
    s = add(c.statements.filter("ord <> 11"), "text", (F.col("ord") % 10 == 3) & (F.col("doc_id") % 2 == 0), " (theirs)")
    touching = F.array_contains(F.concat("premises", "conclusions"), "s11")
    return ours, replace(c, statements=s, arguments=c.arguments.filter(~touching))


_MERGE = """+ b as (select doc_id, id, ord, canon as k from statements),
o as (select doc_id, id, ord, case when ord % 10 = 3 then canon || ' (ours)' else canon end as k from statements),
t as (select doc_id, id, ord, case when ord % 10 = 3 and doc_id % 2 = 0 then canon || ' (theirs)' else canon end as k from statements where ord <> 11),
j as (select doc_id, id, b.k as kb, o.k as ko, t.k as kt from b full join o using (doc_id, id) full join t using (doc_id, id)),
c as (select *, ko is distinct from kt and ko is distinct from kb and kt is distinct from kb as conflict,
  case when ko is not distinct from kt then ko when ko is not distinct from kb then kt when kt is not distinct from kb then ko else coalesce(ko, kt) end as k from j)
"""


@_query(_MERGE + "select doc_id, id, k as text, conflict from c where k is not null")
def merge_statements(spark, sf):
    c = orders_corpus(spark, sf)
    s, _ = versions.merge_items(c, *_sides(c), plain=True)
    from ..functions.text import collapse

    return s.filter("chosen is not null").select("doc_id", "id", collapse(F.col("row.text")).alias("text"), "conflict")


@_query(_MERGE + """select doc_id, count(*) filter (k is not null and k is not distinct from kb) as kept, 0::bigint as added_ours, 0::bigint as added_theirs, 0::bigint as added_both,
  count(*) filter (k is null) as removed, count(*) filter (k is distinct from kb and k is not null) as changed from c group by 1""")  # fmt: skip
def merge_tallies(spark, sf):
    c = orders_corpus(spark, sf)
    return versions.tallies(versions.merge_items(c, *_sides(c), plain=True)[0])


@_query("""+ touch as (select distinct doc_id, aid, arg_key from incidence where slot = 11)
select doc_id, aid as id, 'argument' as kind, 'kept ours' as resolution from touch where arg_key % 5 = 1
union all select doc_id, aid, 'dangling', 'dropped argument' from touch where arg_key % 5 = 1
union all select doc_id, id, 'statement', 'kept ours' from statements where ord % 10 = 3 and doc_id % 2 = 0""")
def merge_conflicts(spark, sf):
    c = orders_corpus(spark, sf).written()
    s, a = versions.merge_items(c, *_sides(c), plain=True)
    return versions.conflicts(s, a).select("doc_id", "id", "kind", "resolution")


def _broken(c: Corpus) -> Corpus:
    """A copy with repeated ids and references to nothing."""
    twice = c.statements.filter("ord = 5").withColumn("ord", F.col("ord") + 1000)
    bad = F.col("ord") % 17 == 0
    a = c.arguments.withColumn("premises", F.when(bad, F.transform("premises", lambda x: F.lit("s999"))).otherwise(F.col("premises")))
    return replace(c, statements=c.statements.unionByName(twice), arguments=a)


@_query("select doc_id, ord + 1000 as ord, id from statements where ord = 5")
def duplicate_ids(spark, sf):
    return documents.duplicate_ids(_broken(orders_corpus(spark, sf)).statements)


@_query("select doc_id, aid as arg_id, 'premises' as side, 's999' as ref from incidence where side = 'p' and arg_key % 17 = 0")
def unknown_references(spark, sf):
    return documents.unknown_references(_broken(orders_corpus(spark, sf))).select("doc_id", "arg_id", "side", "ref")


# Search, filters, edits.


@_query("select doc_id, id, text from statements where mode = 'ought' and contains(lower(text), 'suits b')")
def filter_statements(spark, sf):
    return editing.filter_statements(orders_corpus(spark, sf), "suits B", "ought").select("doc_id", "id", "text")


@_query("""select doc_id, id from arguments a where contains(lower(justification), '1-u') or contains(lower(id), '1-u') or contains(lower(coalesce(rule, '')), '1-u')""")
def filter_arguments(spark, sf):
    return editing.filter_arguments(orders_corpus(spark, sf), "1-U").select("doc_id", "id")


@_query("""+ scored as (select doc_id, ord, id, case when id = 's1' then 0 when starts_with(id, 's1') then 1 when contains(id, 's1') then 2 when contains(lower(text), 's1') then 3 end as score from statements),
ranked as (select *, row_number() over (partition by doc_id order by score, ord) as rank from scored where score is not null)
select doc_id, rank, score::bigint as score, id from ranked where rank <= 5""")
def search_statements(spark, sf):
    return editing.search_statements(orders_corpus(spark, sf), "S1", limit=5)


@_query("""+ kept as (select doc_id, aid, string_agg(sid, ',' order by slot) filter (side = 'p') as premises, string_agg(sid, ',' order by slot) filter (side = 'c') as conclusions
  from incidence where slot % 9 <> 4 group by 1, 2)
select doc_id, aid as id, coalesce(premises, '') as premises, conclusions from kept where conclusions is not null""")
def delete_statements(spark, sf):
    c = orders_corpus(spark, sf)
    out = editing.delete_statements(c, c.statements.filter(F.col("ord") % 9 == 4).select("doc_id", "id"))
    return out.arguments.select("doc_id", "id", _joined("premises").alias("premises"), _joined("conclusions").alias("conclusions"))


# Renderers.

_DOT_SQL = """select doc_id, 1 as section, ord, 0::bigint as pos, '  s' || ord || {node} as line from statements
union all select doc_id, 2, ord, 0, '  a' || ord || {hub} from arguments
union all select doc_id, 3, arg_key, row_number() over (partition by doc_id, arg_key order by side desc, slot) - 1,
  case when side = 'p' then '  s' || slot || '{arrow}a' || arg_key || '{end}' else '  a' || arg_key || '{arrow}s' || slot || '{end}' end from incidence"""


@_query(_DOT_SQL.format(node="""' [shape=box, style=rounded, label="' || id || '\\n' || regexp_replace(text, '^  Part', '  Part') || '"' || case when mode = 'ought' then ', peripheries=2' else '' end || '];'""",
    hub="""' [shape=diamond, fontsize=8, label="' || id || case when rule is not null then '\\n' || rule else '' end || '"];'""", arrow=" -> ", end=";"))
def dot_lines(spark, sf):
    c = orders_corpus(spark, sf)
    return rendering.dot_lines(c)


@_query(_DOT_SQL.format(node="""'["' || id || '<br/>' || text || '"]'""", hub="""'{{"' || id || case when rule is not null then '<br/>' || rule else '' end || '"}}'""", arrow=" --> ", end=""))
def mermaid_lines(spark, sf):
    return rendering.mermaid_lines(orders_corpus(spark, sf))


# Extraction.


@_query("select doc_id, greatest(1, ceil(length(coalesce(text, '')) / 3.5))::bigint as tokens from documents", base="")
def tokens_estimate(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", estimate_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


_LINES = """lines as (select doc_id, i, trim(string_split(text, chr(10))[i], ' ' || chr(9)) as line from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i)),
paras as (select doc_id, line, row_number() over (partition by doc_id order by i) as n from lines where line <> '')"""


@_query(f"with {_LINES} select doc_id, 'p' || n as key, line as text from paras", base="")
def paragraphs(spark, sf):
    return extraction.paragraphs(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "key", "text")


@_query(f"""with recursive {_LINES},
sized as (select doc_id, n, greatest(1, ceil(length(line) / 3.5))::bigint as t from paras),
pack(doc_id, n, chunk, used) as (select doc_id, n, 0::bigint, t from sized where n = 1
  union all select s.doc_id, s.n, case when p.used + s.t > 600 then p.chunk + 1 else p.chunk end, case when p.used + s.t > 600 then s.t else p.used + s.t end
  from pack p join sized s on s.doc_id = p.doc_id and s.n = p.n + 1)
select doc_id, chunk, count(*) as paragraphs, 'p' || min(n) as first_key from pack group by 1, 2""", base="")  # fmt: skip
def chunks(spark, sf):
    out = extraction.chunks(extraction.paragraphs(spark.read.parquet(f"{sf}/documents.parquet")), 600)
    return out.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("keys").cast("long").alias("paragraphs"), F.col("keys")[0].alias("first_key"))


@_query("""with c as (select conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations)
select text, role, min(conv_id * 1000 + turn) as first, count(*) as n, string_agg(distinct conv_id::varchar, ',' order by conv_id::varchar) as sources from c where text <> '' group by 1, 2""", base="")  # fmt: skip
def exact_candidates(spark, sf):
    """Turns as candidate statements: one for each canonical text and role."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = turns.select(F.lit("all").alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("mode"), F.array(F.col("conv_id").cast("string")).alias("sources"), F.array(F.lit(0)).alias("chunks"), F.lit("stated").alias("role"), F.lit("").alias("note"))
    out = extraction.consolidate_exact(rows)
    return out.select(F.col("canon").alias("text"), "mode", F.col("seq").alias("first"), F.col("n"), _joined(F.array_sort("sources")).alias("sources")).withColumnRenamed("mode", "role")


from . import more as _more  # noqa: E402, F401  registers further queries
from . import wide as _wide  # noqa: E402, F401
