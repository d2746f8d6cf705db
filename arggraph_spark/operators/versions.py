"""Identity-based difference of two versions, and three-way merge."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canon, netstring, netstrings
from ..sources.corpus import Corpus, per_document
from ..sources.documents import ARGUMENT_FIELDS, STATEMENT_FIELDS, as_item, to_json
from . import identity
from .fixpoint import cut
from .graph import _schema


def _matched(rows: DataFrame, key: str) -> DataFrame:
    """Rows (doc_id, side 'a' or 'b', id, ord, ``key``, ...) of both sides, paired by equal key and rank in file order: (doc_id, rank, first, a, b).

    ``a`` and ``b`` are the rows as structs, null on the side that has none; ``first`` is the key's first place in a.
    What has no key stays alone. All is dealt by (doc_id, key) once.
    """
    on_a = F.col("side") == "a"
    rows = rows.repartition(key, "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key, "doc_id", "side").orderBy("ord")))
    ranked = ranked.withColumn("first", F.min(F.when(on_a, F.col("ord"))).over(Window.partitionBy(key, "doc_id")))
    whole = F.struct(*(c for c in rows.columns if c not in ("doc_id", "side")))
    met = ranked.groupBy(key, "doc_id", "rank", F.when(F.col(key).isNull(), F.col("side")).alias("alone"))
    return met.agg(F.min("first").alias("first"), F.first(F.when(on_a, whole), ignorenulls=True).alias("a"), F.first(F.when(~on_a, whole), ignorenulls=True).alias("b")).select("doc_id", "rank", "first", "a", "b")


def _sides(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``both`` for ``_matched``."""
    return rows.select(F.col("doc_id.doc_id").alias("doc_id"), F.when(F.col("doc_id.version") == 0, "a").otherwise("b").alias("side"), "id", "ord", *keys)


def _sided(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    side = lambda t, s: t.select("doc_id", F.lit(s).alias("side"), "id", "ord", *keys)
    return side(a, "a").unionByName(side(b, "b"))


def _rest(pairs: DataFrame) -> DataFrame:
    """What ``_matched`` found no partner for, as rows of its kind."""
    alone = pairs.filter("a is null or b is null")
    return alone.select("doc_id", F.when(F.col("a").isNotNull(), "a").otherwise("b").alias("side"), F.inline(F.array(F.coalesce("a", "b"))))


def _status(pairs: DataFrame, paired: str, rest: bool) -> DataFrame:
    """(doc_id, status, id_a, id_b, seq, rank) of pairs and, with ``rest``, of what has no partner: added or removed."""
    both_ = F.col("a").isNotNull() & F.col("b").isNotNull()
    status = F.when(both_, paired).when(F.col("a").isNotNull(), "removed").otherwise("added").alias("status")
    seq = F.when(both_, F.col("first")).otherwise(F.coalesce("a.ord", "b.ord")).cast("long").alias("seq")
    rank = F.when(both_, F.col("rank")).otherwise(1).cast("long").alias("rank")
    return (pairs if rest else pairs.filter(both_)).select("doc_id", status, F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), seq, rank)


def both(a: Corpus, b: Corpus) -> Corpus:
    """Two versions as one corpus whose documents are keyed by (version 0 or 1, doc_id), so that what is made of both is made in one pass."""
    key = lambda t, n: t.withColumn("doc_id", F.struct(F.lit(n).alias("version"), F.col("doc_id").alias("doc_id")))
    return Corpus(*(key(x, 0).unionByName(key(y, 1)) for x, y in ((a.docs, b.docs), (a.statements, b.statements), (a.arguments, b.arguments))))


def apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``both`` by version, with the documents' own ids."""
    side = lambda n: rows.filter(F.col("doc_id.version") == n).withColumn("doc_id", F.col("doc_id.doc_id"))
    return side(0), side(1)


def diff_statements(a: Corpus, b: Corpus, ids_a: DataFrame | None = None, ids_b: DataFrame | None = None) -> DataFrame:
    """(doc_id, status, id_a, id_b, seq, rank): identical (same justified id), rejustified (same proposition), added, removed.

    Within a status the order is that of (seq, rank): of pairs, the place where their key first stands in ``a``.
    """
    keys = ("just_id", "prop_id")
    rows = _sides(identity.statement_ids(both(a, b)), *keys) if ids_a is None or ids_b is None else _sided(ids_a, ids_b, *keys)
    same = cut(_matched(rows, "just_id"))
    again = _matched(_rest(same), "prop_id")
    return _status(same, "identical", rest=False).unionByName(_status(again, "rejustified", rest=True))


def diff_arguments(a: Corpus, b: Corpus) -> DataFrame:
    """(doc_id, status, id_a, id_b, seq, rank): identical, added or removed, by argument hash."""
    return _status(_matched(_sides(identity.argument_hashes(both(a, b)), "arg_hash"), "arg_hash"), "identical", rest=True)


def diff_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("n"))


def diff_report(a: Corpus, b: Corpus) -> DataFrame:
    """(doc_id, report): the difference of each document's two versions as JSON, lists in order."""
    ia, ib = identity.statement_ids(a), identity.statement_ids(b)
    of = lambda t, s, *cols: t.select("doc_id", F.col("id").alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in cols))
    s = diff_statements(a, b, ia, ib).join(of(ia, "a", "just_id", "prop_id"), ["doc_id", "id_a"], "left")
    for t, n in ((a, "a"), (b, "b")):
        s = s.join(of(t.statements, n, "text", "mode"), ["doc_id", f"id_{n}"], "left")
    h = diff_arguments(a, b).join(of(identity.argument_hashes(a), "a", "arg_hash"), ["doc_id", "id_a"], "left")
    for t, n in ((a, "a"), (b, "b")):
        h = h.join(of(t.arguments, n, "premises", "conclusions"), ["doc_id", f"id_{n}"], "left")
    gather = lambda t, n: t.groupBy("doc_id").agg(F.collect_list(F.struct(*(c for c in t.columns if c != "doc_id"))).alias(n))
    both = a.docs.select("doc_id").union(b.docs.select("doc_id")).distinct()
    frame = both.join(gather(s, "s"), "doc_id", "left").join(gather(h, "h"), "doc_id", "left")

    def kernel(row: dict):
        rows = {n: sorted(row[n] or [], key=lambda r: (r["seq"], r["rank"])) for n in "sh"}
        of = lambda n, status: [r for r in rows[n] if r["status"] == status]
        pick = lambda r, n, *keys: {"id": r[f"id_{n}"], **{k: r[f"{k}_{n}"] for k in keys}}
        statements = {
            "identical": [{"a": r["id_a"], "b": r["id_b"], "just_id": r["just_id_a"]} for r in of("s", "identical")],
            "rejustified": [{"a": r["id_a"], "b": r["id_b"], "prop_id": r["prop_id_a"], "text": r["text_b"]} for r in of("s", "rejustified")],
            "added": [pick(r, "b", "text", "mode") for r in of("s", "added")],
            "removed": [pick(r, "a", "text", "mode") for r in of("s", "removed")],
        }
        arguments = {
            "identical": [{"a": r["id_a"], "b": r["id_b"], "arg_hash": r["arg_hash_a"]} for r in of("h", "identical")],
            "added": [pick(r, "b", "premises", "conclusions") for r in of("h", "added")],
            "removed": [pick(r, "a", "premises", "conclusions") for r in of("h", "removed")],
        }
        sizes = {k: {n: len(v) for n, v in t.items()} for k, t in (("statements", statements), ("arguments", arguments))}
        yield row["doc_id"], json.dumps({"statements": statements, "arguments": arguments, "summary": sizes}, ensure_ascii=False)

    return per_document(frame, kernel, _schema(a, "report string"))


def _freeze(x):
    """A value by which JSON values compare: key order aside, true as 1 and 1.0, and an empty object as an empty list."""
    if isinstance(x, dict):
        return ["o", sorted(([k, _freeze(v)] for k, v in x.items()), key=lambda kv: kv[0])] if x else ["l"]
    if isinstance(x, list):
        return ["l", *map(_freeze, x)]
    if isinstance(x, (bool, int, float)):
        return ["n", int(x) if float(x).is_integer() else repr(float(x))]
    return ["s", x]


@F.pandas_udf(T.StringType())
def freeze(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "absent" if x is None else json.dumps(_freeze(json.loads(x)), ensure_ascii=False))


def frozen(c: str) -> Column:
    """Only values that are there cross to Python."""
    return F.when(F.col(c).isNull(), F.lit("absent")).otherwise(freeze(F.col(c)))


def _key(kind: str, plain: bool) -> Column:
    """What decides whether two versions of an item are equal, as one hash."""
    rest = [] if plain else [netstring(frozen("meta_json")), netstring(frozen("ext_json"))]
    if kind == "statement":
        return F.sha2(F.concat(netstring(canon(F.col("text"))), netstring(F.col("mode")), *rest), 256)
    sets = [netstrings(F.array_sort(F.array_distinct(F.col(c)))) for c in ("premises", "conclusions")]
    rule = F.coalesce(F.concat(F.lit("="), netstring(F.col("rule"))), F.lit("-"))
    return F.sha2(F.concat(*sets, netstring(canon(F.col("justification"))), rule, *rest), 256)


def _three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, kind: str, plain: bool) -> DataFrame:
    """One row for each id with what each side has, which is chosen ('o', 't' or null) and whether the sides conflict."""
    body = [c for c in base.columns if c not in ("doc_id", "id", "ord")]
    side = lambda t, s: t.select("doc_id", "id", F.col("ord").alias(f"ord_{s}"), _key(kind, plain).alias(f"k_{s}"), F.struct(*body).alias(f"row_{s}"))
    # The sides' rows meet in one shuffle; dealt out before, they are sorted once, as nothing is gained by gathering on both sides of it.
    rows = side(base, "b").unionByName(side(ours, "o"), allowMissingColumns=True).unionByName(side(theirs, "t"), allowMissingColumns=True)
    all_ = rows.repartition("doc_id", "id").groupBy("doc_id", "id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in (f"{c}_{s}" for s in "bot" for c in ("ord", "k", "row"))))
    b, o, t = F.col("k_b"), F.col("k_o"), F.col("k_t")
    agree = o.eqNullSafe(t) | t.eqNullSafe(b)
    take_theirs = ~o.eqNullSafe(t) & o.eqNullSafe(b)
    conflict = ~agree & ~o.eqNullSafe(b)
    side_ = F.when(take_theirs, F.when(t.isNotNull(), "t")).when(o.isNotNull(), "o").when(conflict & t.isNotNull(), "t")
    out = all_.withColumn("chosen", side_).withColumn("conflict", conflict)
    out = out.withColumn("k", F.when(F.col("chosen") == "o", o).when(F.col("chosen") == "t", t)).withColumn("row", F.when(F.col("chosen") == "o", F.col("row_o")).when(F.col("chosen") == "t", F.col("row_t")))
    # Base order, then what is new in ours, then in theirs.
    seq = F.struct(F.when(F.col("ord_b").isNotNull(), 0).when(F.col("ord_o").isNotNull(), 1).otherwise(2).alias("part"), F.coalesce("ord_b", "ord_o", "ord_t").alias("ord"))
    tally = (
        F.when(F.col("chosen").isNull(), F.when(b.isNotNull(), "removed"))
        .when(b.isNull(), F.when(o.isNotNull() & t.isNotNull(), "added_both").when(o.isNotNull(), "added_ours").otherwise("added_theirs"))
        .when(F.col("k").eqNullSafe(b), "kept")
        .otherwise("changed")
    )
    return out.withColumn("seq", seq).withColumn("tally", tally)


def merge_items(base: Corpus, ours: Corpus, theirs: Corpus, plain: bool = False) -> tuple[DataFrame, DataFrame]:
    """The decisions on statements and arguments; ``plain``: no document has meta or ext."""
    return (
        _three_way(base.statements, ours.statements, theirs.statements, "statement", plain),
        _three_way(base.arguments, ours.arguments, theirs.arguments, "argument", plain),
    )


def tallies(items: DataFrame) -> DataFrame:
    """(doc_id, kept, added_ours, added_theirs, added_both, removed, changed)."""
    names = ("kept", "added_ours", "added_theirs", "added_both", "removed", "changed")
    return items.groupBy("doc_id").agg(*(F.count_if(F.col("tally") == n).alias(n) for n in names))


def dangling(statements: DataFrame, arguments: DataFrame) -> DataFrame:
    """(doc_id, id, missing): surviving arguments that refer to statements that didn't; missing in order, repeats kept."""
    alive = statements.filter(F.col("chosen").isNotNull()).select("doc_id", F.col("id").alias("ref"))
    refs = arguments.filter(F.col("chosen").isNotNull()).select("doc_id", "id", F.posexplode(F.concat("row.premises", "row.conclusions")).alias("pos", "ref"))
    lost = refs.join(alive, ["doc_id", "ref"], "left_anti")
    return lost.groupBy("doc_id", "id").agg(F.sort_array(F.collect_list(F.struct("pos", "ref"))).alias("m")).select("doc_id", "id", F.col("m.ref").alias("missing"))


def conflicts(statements: DataFrame, arguments: DataFrame) -> DataFrame:
    """(doc_id, kind, id, resolution, seq, missing) in the order kind_rank, seq: statements, arguments, dangling."""
    none = F.lit(None).cast("array<string>").alias("missing")
    kept = ("doc_id", "id", "k_o", "chosen", "conflict", "seq")
    statements = cut(statements.select(*kept))
    arguments = cut(arguments.select(*kept, F.struct("row.premises", "row.conclusions").alias("row")))
    rows = []
    for n, (kind, items) in enumerate((("statement", statements), ("argument", arguments))):
        how = F.when(F.col("k_o").isNotNull(), "kept ours").otherwise("kept theirs")
        rows.append(items.filter("conflict").select("doc_id", F.lit(n).alias("kind_rank"), F.lit(kind).alias("kind"), "id", how.alias("resolution"), "seq", none))
    lost = dangling(statements, arguments).join(arguments.select("doc_id", "id", "seq"), ["doc_id", "id"])
    rows.append(lost.select("doc_id", F.lit(2).alias("kind_rank"), F.lit("dangling").alias("kind"), "id", F.lit("dropped argument").alias("resolution"), "seq", "missing"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def merge(base: Corpus, ours: Corpus, theirs: Corpus, plain: bool = False) -> tuple[Corpus, DataFrame]:
    """The merged corpus and its conflicts (statement, argument, dangling and header rows).

    Per id: where both sides agree ours is taken, where one changed that one, and where both did ours, or theirs if
    ours is gone. Arguments left without a statement they need are dropped.
    """
    s, a = merge_items(base, ours, theirs, plain)
    lost = dangling(s, a)
    ordered = lambda t: t.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).cast("int"))
    statements = ordered(s.filter(F.col("chosen").isNotNull())).select("doc_id", "ord", "id", "row.*")
    arguments = ordered(a.filter(F.col("chosen").isNotNull()).join(lost, ["doc_id", "id"], "left_anti")).select("doc_id", "ord", "id", "row.*")
    fields = ("name", "description", "meta_json", "ext_json")
    head = lambda c, x: c.docs.select("doc_id", *(F.col(f).alias(f"{f}_{x}") for f in fields), *([F.col("source"), F.col("version")] if x == "o" else []))
    h = head(base, "b").join(head(ours, "o"), "doc_id").join(head(theirs, "t"), "doc_id")
    clash, picked = [], []
    for n, f in enumerate(fields):
        b, o, t = (F.col(f"{f}_{x}") if f in ("name", "description") else frozen(f"{f}_{x}") for x in "bot")
        rows = tuple(F.col(f"{f}_{x}") for x in "bot")
        bad = ~o.eqNullSafe(t) & ~o.eqNullSafe(b) & ~t.eqNullSafe(b)
        picked.append(F.when(~o.eqNullSafe(t) & o.eqNullSafe(b), rows[2]).when(bad, F.coalesce(rows[1], rows[2])).otherwise(rows[1]).alias(f))
        clash.append(F.when(bad, F.struct(F.lit(n).alias("n"), F.lit(f.removesuffix("_json")).alias("id"))))
    docs = h.select("doc_id", "source", "version", *picked)
    struct = F.struct(F.col("c.n").alias("part"), F.lit(0).cast(s.schema["seq"].dataType.fields[1].dataType).alias("ord"))
    heads = h.select("doc_id", F.explode(F.filter(F.array(*clash), lambda c: c.isNotNull())).alias("c"))
    heads = heads.select("doc_id", F.lit(3).alias("kind_rank"), F.lit("header").alias("kind"), F.col("c.id").alias("id"), F.lit("kept ours").alias("resolution"), struct.alias("seq"), F.lit(None).cast("array<string>").alias("missing"))
    return Corpus(docs, statements, arguments), conflicts(s, a).unionByName(heads)


def merge_report(base: Corpus, ours: Corpus, theirs: Corpus) -> DataFrame:
    """(doc_id, report): merged document, conflicts in order, and tallies, as JSON."""
    s, a = merge_items(base, ours, theirs)
    merged, clashes = merge(base, ours, theirs)
    sides = F.struct("row_b", "row_o", "row_t", "row")
    shown = lambda t, kind: t.select("doc_id", F.lit(kind).alias("kind"), "id", sides.alias(kind))
    rows = clashes.join(shown(s, "statement"), ["doc_id", "kind", "id"], "left").join(shown(a, "argument"), ["doc_id", "kind", "id"], "left")
    rows = rows.join(a.select("doc_id", "id", F.lit("dangling").alias("kind"), F.col("row").alias("dropped")), ["doc_id", "kind", "id"], "left")
    rows = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "doc_id"))).alias("conflicts"))
    heads = lambda c, n: c.docs.select("doc_id", F.struct("name", "description", "meta_json", "ext_json").alias(f"head_{n}"))
    frame = to_json(merged, None).join(rows, "doc_id", "left")
    for c, n in ((base, "b"), (ours, "o"), (theirs, "t")):
        frame = frame.join(heads(c, n), "doc_id")
    for t, n in ((s, "tally_s"), (a, "tally_a")):
        counted = tallies(t)
        frame = frame.join(counted.select("doc_id", F.struct(*(c for c in counted.columns if c != "doc_id")).alias(n)), "doc_id", "left")

    def kernel(d: dict):
        out = []
        for c in sorted(d["conflicts"] or [], key=lambda c: (c["kind_rank"], c["seq"]["part"], c["seq"]["ord"] or 0)):
            one = {"kind": c["kind"], "id": c["id"]}
            if c["kind"] == "dangling":
                one |= {"missing": c["missing"], "argument": as_item(c["dropped"] | {"id": c["id"]}, ARGUMENT_FIELDS)}
            elif c["kind"] == "header":
                key = c["id"]
                value = lambda h, key=key: h[key] if key in h else (json.loads(h[f"{key}_json"]) if h[f"{key}_json"] is not None else None)
                one |= {"base": value(d["head_b"]), "ours": value(d["head_o"]), "theirs": value(d["head_t"])}
            else:
                fields = STATEMENT_FIELDS if c["kind"] == "statement" else ARGUMENT_FIELDS
                both = c[c["kind"]]
                one |= {n: as_item(both[r] | {"id": c["id"]}, fields) if both[r] else None for n, r in (("base", "row_b"), ("ours", "row_o"), ("theirs", "row_t"))}
            out.append(one | {"resolution": c["resolution"]})
        none = dict.fromkeys(("kept", "added_ours", "added_theirs", "added_both", "removed", "changed"), 0)
        summary = {"statements": d["tally_s"] or none, "arguments": d["tally_a"] or none}
        yield d["doc_id"], json.dumps({"merged": json.loads(d["json"]), "conflicts": out, "summary": summary}, ensure_ascii=False)

    return per_document(frame, kernel, _schema(base, "report string"))
