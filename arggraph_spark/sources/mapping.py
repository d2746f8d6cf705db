"""Argument corpora derived from the star-schema test tables, and the same definitions as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fixpoint import cut
from .corpus import Corpus


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """A document for each customer; an order argues from the slots of all its other lines to that of line 1.

    Parts are folded to 40 slots so that a customer's orders share statements, which makes cycles.
    """
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("slot"), "l_linenumber")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    slots = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("slot"))))
    sides = lines.groupBy("l_orderkey").agg(slots(F.col("l_linenumber") == 1).alias("c"), slots(F.col("l_linenumber") > 1).alias("p")).filter(F.size("c") > 0)
    joined = cut(orders.join(sides, orders.o_orderkey == sides.l_orderkey).drop("l_orderkey"))  # what all three tables are made of
    named = lambda c: F.transform(c, lambda s: F.concat(F.lit("s"), s.cast("string")))
    null = F.lit(None).cast("string")
    arguments = joined.select(
        F.col("o_custkey").alias("doc_id"),
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("id"),
        named("p").alias("premises"),
        named("c").alias("conclusions"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("justification"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("rule"),
        null.alias("meta_json"),
        null.alias("ext_json"),
    )
    used = joined.select(F.col("o_custkey").alias("doc_id"), F.explode(F.concat("p", "c")).alias("ord")).distinct()
    customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    text = F.concat(F.when(F.col("ord") % 5 == 0, "  Part ").otherwise("Part "), (F.col("ord") % 13).cast("string"), F.lit("  suits "), F.col("c_mktsegment"))
    statements = used.join(customer, "doc_id").select(
        "doc_id", "ord", F.concat(F.lit("s"), F.col("ord").cast("string")).alias("id"), text.alias("text"), F.when(F.col("ord") % 3 == 0, "ought").otherwise("is").alias("mode"), null.alias("meta_json"), null.alias("ext_json")
    )
    docs = joined.select(F.col("o_custkey").alias("doc_id")).distinct()
    docs = docs.select("doc_id", null.alias("source"), F.lit("0.1").alias("version"), F.concat(F.lit("customer "), F.col("doc_id").cast("string")).alias("name"), null.alias("description"), null.alias("meta_json"), null.alias("ext_json"))
    return Corpus(docs, statements, arguments)


#: Statements, arguments, incidence (side p or c) and edges of the same corpus, for WITH.
ORDERS_SQL = """
wv_lines as (select distinct o.o_custkey as doc_id, o.o_orderkey as arg_key, l.l_partkey % 40 as slot, case when l.l_linenumber = 1 then 'c' else 'p' end as side
  from orders o join lineitem l on l.l_orderkey = o.o_orderkey),
wv_arg_keys as (select distinct doc_id, arg_key from wv_lines where side = 'c'),
incidence as (select x.*, 's' || x.slot as sid, 'a' || x.arg_key as aid from wv_lines x join wv_arg_keys k on x.doc_id = k.doc_id and x.arg_key = k.arg_key),
statements as (select s.doc_id, s.slot as ord, 's' || s.slot as id,
  case when s.slot % 5 = 0 then '  Part ' else 'Part ' end || (s.slot % 13) || '  suits ' || c.c_mktsegment as text,
  'Part ' || (s.slot % 13) || ' suits ' || c.c_mktsegment as canon, case when s.slot % 3 = 0 then 'ought' else 'is' end as mode
  from (select distinct doc_id, slot from incidence) s join customer c on c.c_custkey = s.doc_id),
arguments as (select k.doc_id, k.arg_key as ord, 'a' || k.arg_key as id, case when k.arg_key % 11 = 0 then '  ' else o.o_orderpriority end as justification,
  case when k.arg_key % 2 = 0 then o.o_orderstatus end as rule from wv_arg_keys k join orders o on o.o_orderkey = k.arg_key),
edges as (select distinct p.doc_id, p.sid as src, c.sid as dst from incidence p join incidence c on p.doc_id = c.doc_id and p.arg_key = c.arg_key where p.side = 'p' and c.side = 'c')
"""


def layers_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """One document without cycles: an order argues from its parts below its top layer (l_partkey % 4) to those in it."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    layer = lambda p: p % 4
    sides = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"), F.max(F.col("l_partkey") % 4).alias("top"), F.min(F.col("l_partkey") % 4).alias("low")).filter("top > low")
    sides = cut(sides)
    named = lambda c: F.transform(c, lambda s: F.concat(F.lit("p"), s.cast("string")))
    null = F.lit(None).cast("string")
    doc = F.lit("layers")
    arguments = sides.select(doc.alias("doc_id"), F.col("l_orderkey").alias("ord"), F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("id"),
        named(F.filter("parts", lambda p: layer(p) < F.col("top"))).alias("premises"), named(F.filter("parts", lambda p: layer(p) == F.col("top"))).alias("conclusions"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("justification"), null.alias("rule"), null.alias("meta_json"), null.alias("ext_json"))
    used = sides.select(F.explode("parts").alias("p_partkey")).distinct()
    statements = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").join(used, "p_partkey").select(
        doc.alias("doc_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("text"), F.when(F.col("p_size") % 2 == 0, "is").otherwise("ought").alias("mode"), null.alias("meta_json"), null.alias("ext_json"))
    docs = spark.range(1).select(doc.alias("doc_id"), null.alias("source"), F.lit("0.1").alias("version"), F.lit("layers").alias("name"), null.alias("description"), null.alias("meta_json"), null.alias("ext_json"))
    return Corpus(docs, statements, arguments)


LAYERS_SQL = """
pairs as (select distinct l_orderkey as arg, l_partkey as part, l_partkey % 4 as layer from lineitem),
tops as (select arg, max(layer) as top from pairs group by arg having max(layer) > min(layer)),
incidence as (select p.arg, p.part, p.layer, t.top, case when p.layer = t.top then 'c' else 'p' end as side from pairs p join tops t on p.arg = t.arg),
props as (select p_partkey as part, p_partkey % 4 as layer, p_name, case when p_size % 2 = 0 then 'is' else 'ought' end as mode from part where p_partkey in (select part from incidence)),
prop_ids as (select part, layer, sha256('4:prop,' || strlen(p_name) || ':' || p_name || ',' || strlen(mode) || ':' || mode || ',') as prop from props)
"""


def trade_corpus(spark: SparkSession, sf_dir: str, open_every: int | None = 3) -> Corpus:
    """One document with a statement for each order, concluded from the same customer's order before and the first of its day.

    A customer's first order is concluded from the last, which makes rings of any lengths, but for customers that
    ``open_every`` divides, whose orders are chains. The first of a day is that of the least customer and counts where
    its customer's number is lower, so rings of different customers don't meet.
    """
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d"), "o_orderpriority", "o_orderstatus")
    mine = Window.partitionBy("c").orderBy("k")
    ring = F.lit(True) if open_every is None else F.col("c") % open_every != 0
    before = F.coalesce(F.lag("k").over(mine), F.when(ring, F.max("k").over(Window.partitionBy("c"))))
    days = orders.groupBy("d").agg(F.min(F.struct("c", "k")).alias("first"))
    linked = orders.withColumn("before", before).join(days, "d").withColumn("day", F.when(F.col("first.c") < F.col("c"), F.col("first.k")))
    doc, null = F.lit("trade").alias("doc_id"), F.lit(None).cast("string")
    named = lambda c: F.concat(F.lit("o"), c.cast("string"))
    premises = F.transform(F.array_compact(F.array("before", "day")), named)
    arguments = linked.filter("before is not null or day is not null").select(doc, F.col("k").alias("ord"), F.concat(F.lit("a"), F.col("k").cast("string")).alias("id"), premises.alias("premises"), F.array(named(F.col("k"))).alias("conclusions"), F.concat(F.lit("order "), F.col("k").cast("string")).alias("justification"), null.alias("rule"), null.alias("meta_json"), null.alias("ext_json"))
    statements = orders.select(doc, F.col("k").alias("ord"), named(F.col("k")).alias("id"), F.concat(F.lit("Order of "), "o_orderpriority").alias("text"), F.when(F.col("o_orderstatus") == "O", "ought").otherwise("is").alias("mode"), null.alias("meta_json"), null.alias("ext_json"))
    docs = spark.range(1).select(doc, null.alias("source"), F.lit("0.1").alias("version"), F.lit("trade").alias("name"), null.alias("description"), null.alias("meta_json"), null.alias("ext_json"))
    return Corpus(docs, statements, arguments)


#: Premises, components (by their first statement) and levels of the same document; ``{ring}`` tells which customers have rings.
TRADE_SQL = """
ords as (select o_orderkey as k, o_custkey as c, o_orderdate as d, 'Order of ' || o_orderpriority as text, case when o_orderstatus = 'O' then 'ought' else 'is' end as mode from orders),
linked as (select *, coalesce(lag(k) over (partition by c order by k), case when {ring} then max(k) over (partition by c) end) as before from ords),
days as (select d, min({{'c': c, 'k': k}}) as first from ords group by d),
given as (select k as arg, before as s from linked where before is not null union all select l.k, y.first.k from linked l join days y on y.d = l.d where y.first.c < l.c),
comps as materialized (select k, c, case when {ring} then min(k) over (partition by c) else k end as comp, {ring} as cyclic from ords),
steps as materialized (select distinct a.comp as s, b.comp as t from given g join comps a on a.k = g.s join comps b on b.k = g.arg where a.comp <> b.comp),
way(comp, n) as (select comp, 0 from comps union select t, n + 1 from way join steps on s = way.comp),
level as materialized (select comp, max(n) as level from way group by comp)
"""
