"""Reading, validating and writing JSON documents. A bad file becomes rows of problems, not a failed job."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE_CLASS
from .corpus import ARGUMENTS, DOCS, STATEMENTS, Corpus, LoadError, ValidationError, per_document

# The format's name and fields.
FORMAT = "worldview-core"
DOCUMENT_FIELDS = ["format", "version", "name", "description", "meta", "ext", "statements", "arguments"]
STATEMENT_FIELDS = ["id", "text", "mode", "meta", "ext"]
ARGUMENT_FIELDS = ["id", "premises", "conclusions", "justification", "rule", "meta", "ext"]
MODES = ["is", "ought"]

_ID = re.compile(f"[^{SPACE_CLASS}]+")
_VERSION = re.compile("[0-9]+\\.[0-9]+")


def json_schema() -> dict:
    """The format as a JSON Schema."""
    text, obj = {"type": "string"}, {"type": "object"}
    ident = {"type": "string", "minLength": 1, "pattern": f"^[^{SPACE_CLASS}]+$"}
    ids = lambda n: {"type": "array", "items": ident, "minItems": n, "uniqueItems": True}
    free = {"meta": obj, "ext": {"type": "object", "additionalProperties": obj}}
    item = lambda props, need: {"type": "object", "properties": {**props, **free}, "required": need, "additionalProperties": False}
    statement = item({"id": ident, "text": {"type": "string", "minLength": 1}, "mode": {"enum": MODES}}, ["id", "text", "mode"])
    argument = item({"id": ident, "premises": ids(0), "conclusions": ids(1), "justification": text, "rule": text}, ["id", "premises", "conclusions", "justification"])
    head = {"format": {"const": FORMAT}, "version": {"type": "string", "pattern": "^[0-9]+\\.[0-9]+$"}, "name": text, "description": text}
    lists = {"statements": {"type": "array", "items": statement}, "arguments": {"type": "array", "items": argument}}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **item({**head, **lists}, ["format", "version", "statements", "arguments"])}


# What validation says of each fault.
SAYS = {
    "json": "must be a JSON object",
    "object": "must be an object",
    "unknown": "unknown field {0!r} (extensions belong under 'ext')",
    "missing": "missing required field {0!r}",
    "format": f"'format' must be \"{FORMAT}\", got {{1!r}}",
    "version": "'version' must be a string like \"0.1\", got {1!r}",
    "string": "{0!r} must be a string",
    "array": "{0!r} must be an array",
    "id": "'id' must be a non-empty string without whitespace, got {1!r}",
    "filled": "{0!r} must be a non-empty string",
    "mode": "'mode' must be \"is\" or \"ought\", got {1!r}",
    "map": "{0!r} must be an object",
    "namespace": "ext[{1!r}] must be an object (each ext key is a namespace)",
    "ids": "{0!r} must be an array of statement ids",
    "least": "{0!r} must have at least {1} item(s)",
    "item": "{0}[{1}] must be a statement id (non-empty string without whitespace), got {2!r}",
    "repeats": "{0!r} contains duplicate ids",
    "again": "duplicate {0} id {1!r}",
    "dangling": "{0} references unknown statement {1!r}",
}


def _is_id(x) -> bool:
    return isinstance(x, str) and _ID.fullmatch(x) is not None


def _must(code: str, fits):
    """A test: the faults (code, arguments) of a field's value, here at most one."""
    return lambda value: [] if fits(value) else [(code, value)]


def _of(kind: type):
    return lambda value: isinstance(value, kind)


def _namespaces(value):
    return [("namespace", k) for k, v in value.items() if not isinstance(v, dict)] if isinstance(value, dict) else [("map", value)]


def _refs(least: int):
    def test(value):
        if not isinstance(value, list):
            return [("ids", value)]
        distinct = {x for x in value if isinstance(x, str)}  # what isn't a string counts as a repeat too
        return [("least", least)] * (len(value) < least) + [("item", j, x) for j, x in enumerate(value) if not _is_id(x)] + [("repeats",)] * (len(distinct) < len(value))

    return test


# The rules: for each kind of object its fields, whether each must be there, and its test, in the order of the faults.
_FREE = [("meta", False, _must("map", _of(dict))), ("ext", False, _namespaces)]
RULES = {
    "document": [
        ("format", True, _must("format", lambda v: v == FORMAT)),
        ("version", True, _must("version", lambda v: isinstance(v, str) and _VERSION.fullmatch(v) is not None)),
        ("name", False, _must("string", _of(str))),
        ("description", False, _must("string", _of(str))),
        *_FREE,
        ("statements", True, _must("array", _of(list))),
        ("arguments", True, _must("array", _of(list))),
    ],
    "statements": [("id", True, _must("id", _is_id)), ("text", True, _must("filled", lambda v: isinstance(v, str) and v != "")), ("mode", True, _must("mode", lambda v: v in MODES)), *_FREE],
    "arguments": [
        ("id", True, _must("id", _is_id)), ("premises", True, _refs(0)), ("conclusions", True, _refs(1)),
        ("justification", True, _must("string", _of(str))), ("rule", False, _must("string", _of(str))), *_FREE,
    ],
}


def _faults(kind: str, x: dict) -> list[tuple]:
    """(field, code, arguments) of one object by the rules of its kind; unknown fields first, a document's missing ones next."""
    rules = RULES[kind]
    known = {f for f, _, _ in rules}
    out = [(f, "unknown") for f in x if f not in known]
    absent = [(f, "missing") for f, need, _ in rules if need and f not in x]
    if kind == "document":
        out, absent = out + absent, []
    for f, _, test in rules:
        out += [(f, *fault) for fault in test(x[f])] if f in x else [m for m in absent if m[0] == f]
    return out


def _cells(data: dict):
    """(place, kind, object) of a document and of each of its items; no kind for what isn't an object."""
    yield "document", "document", data
    for kind in ("statements", "arguments"):
        items = data.get(kind)
        for i, x in enumerate(items if isinstance(items, list) else []):
            yield f"{kind}[{i}]", kind if isinstance(x, dict) else None, x


def _dangling(data: dict):
    """(place, code, arguments) of repeated ids and references to nothing, of a document that is sound otherwise."""
    first = {kind: {x["id"]: i for i, x in reversed([*enumerate(data[kind])])} for kind in ("statements", "arguments")}
    for kind in first:
        for i, x in enumerate(data[kind]):
            if first[kind][x["id"]] < i:
                yield f"{kind}[{i}]", "again", kind[:-1], x["id"]
            refs = [(side, ref) for side in ("premises", "conclusions") if kind == "arguments" for ref in x[side]]
            yield from ((f"{kind}[{i}] ({x['id']})", "dangling", *r) for r in refs if r[1] not in first["statements"])


def _sound(kind: str, x) -> bool:
    return isinstance(x, dict) and not _faults(kind, x)


def problems_of(data) -> list[str]:
    """The problems of parsed data, in order; references are looked at only if all objects are sound."""
    if not isinstance(data, dict):
        return [f"document: {SAYS['json']}"]
    out = []
    for place, kind, x in _cells(data):
        if kind is None:
            out.append(f"{place}: {SAYS['object']}")
            continue
        named = f"{place} ({x['id']})" if kind != "document" and _is_id(x.get("id")) else place
        out += [f"{place if code == 'unknown' or f == 'id' else named}: {SAYS[code].format(f, *args)}" for f, code, *args in _faults(kind, x)]
    return out or [f"{place}: {SAYS[code].format(*args)}" for place, code, *args in _dangling(data)]


def validate(data, strict: bool = False) -> list[str]:
    found = problems_of(data)
    if strict and found:
        raise ValidationError(found)
    return found


def _strict_json(text: str):
    def bad(x: str):
        raise ValueError(f"{x} is not JSON")

    data = json.loads(text, parse_constant=bad)
    text.encode()  # a lone surrogate can't be hashed
    json.dumps(data, ensure_ascii=False).encode()
    return data


def sanitize(data) -> dict:
    """The sound part of a document: bad and repeated items go, then references that dangle, then arguments left without a conclusion."""
    d = data if isinstance(data, dict) else {}
    statements: dict[str, dict] = {}
    for s in d.get("statements") if isinstance(d.get("statements"), list) else []:
        if _sound("statements", s):
            statements.setdefault(s["id"], s)
    arguments: dict[str, dict] = {}
    for a in d.get("arguments") if isinstance(d.get("arguments"), list) else []:
        if not isinstance(a, dict) or not isinstance(a.get("id"), str) or not _ID.fullmatch(a["id"]) or a["id"] in arguments:
            continue
        sides = {k: list(dict.fromkeys(x for x in a[k] if isinstance(x, str) and x in statements)) if isinstance(a.get(k), list) else [] for k in ("premises", "conclusions")}
        if sides["conclusions"]:
            just = a.get("justification") if isinstance(a.get("justification"), str) else ""
            arguments[a["id"]] = {k: v for k, v in a.items() if k in ARGUMENT_FIELDS and (k != "rule" or isinstance(v, str))} | sides | {"justification": just}
    head = {k: d[k] for k in ("name", "description") if isinstance(d.get(k), str)}
    return {"format": FORMAT, "version": "0.1", **head, "statements": list(statements.values()), "arguments": list(arguments.values())}


_ROW = "doc_id string, kind string, ord int, id string, a string, b string, c string, premises array<string>, conclusions array<string>, meta_json string, ext_json string"


def parse(raw: DataFrame, id_col: str = "doc_id", json_col: str = "json", permissive: bool = False) -> Corpus:
    """A corpus from a column of JSON texts. Documents with problems have rows in ``problems`` only; ``permissive`` keeps their sound part.

    Texts are parsed once; the tables are filters of that one result, which is written to the shared folder.
    """

    def text(o: dict, k: str):
        return json.dumps(o[k], ensure_ascii=False) if k in o else None

    def kernel(row: dict):
        key = row["doc_id"]
        try:
            data = _strict_json(row["json"] or "")
            found = problems_of(data)
        except (ValueError, RecursionError) as e:
            data, found = None, [f"document: not JSON: {e}"]
        for i, p in enumerate(found):
            yield key, "problem", i, None, p, None, None, None, None, None, None
        if found and not permissive:
            return
        d = sanitize(data) if found else data
        yield key, "doc", 0, d["version"], d.get("name"), d.get("description"), None, None, None, text(d, "meta"), text(d, "ext")
        for i, s in enumerate(d["statements"]):
            yield key, "statement", i, s["id"], s["text"], s["mode"], None, None, None, text(s, "meta"), text(s, "ext")
        for i, a in enumerate(d["arguments"]):
            yield key, "argument", i, a["id"], a["justification"], a.get("rule"), None, a["premises"], a["conclusions"], text(a, "meta"), text(a, "ext")

    from ..operators.fixpoint import cut

    rows = cut(per_document(raw.select(F.col(id_col).cast("string").alias("doc_id"), F.col(json_col).alias("json")), kernel, _ROW))
    of = lambda kind: rows.filter(F.col("kind") == kind)
    null = F.lit(None).cast("string")
    docs = of("doc").select("doc_id", null.alias("source"), F.col("id").alias("version"), F.col("a").alias("name"), F.col("b").alias("description"), "meta_json", "ext_json")
    statements = of("statement").select("doc_id", "ord", "id", F.col("a").alias("text"), F.col("b").alias("mode"), "meta_json", "ext_json")
    arguments = of("argument").select("doc_id", "ord", "id", "premises", "conclusions", F.col("a").alias("justification"), F.col("b").alias("rule"), "meta_json", "ext_json")
    return Corpus(docs, statements, arguments, of("problem").select("doc_id", F.col("ord").alias("seq"), F.col("a").alias("message")))


def read(spark: SparkSession, paths: str | list[str], strict: bool = False, permissive: bool = False) -> Corpus:
    """Documents from JSON files, a file each; doc_id is the path. Bytes that aren't UTF-8 are a problem of their file."""
    raw = spark.read.format("binaryFile").load(paths)
    text = F.col("content").cast("string")
    sound = F.is_valid_utf8(text)
    corpus = parse(raw.select(F.col("path").alias("doc_id"), F.when(sound, text).alias("json")), permissive=permissive)
    if strict:
        unreadable = corpus.problems.filter(F.startswith("message", F.lit("document: not JSON"))).orderBy("doc_id").first()
        if unreadable:
            raise LoadError(f"{unreadable.doc_id}: {unreadable.message}")
        # Every problem is in the error; a corpus with very many of them is better read without ``strict`` and its table looked at.
        if bad := [f"{r.doc_id}: {r.message}" for r in corpus.problems.orderBy("doc_id", "seq").toLocalIterator()]:
            raise ValidationError(bad)
    return corpus


def as_item(x: dict, fields: list[str]) -> dict:
    """A table's row as an object of the format: absent keys absent, meta and ext parsed."""
    out = {}
    for f in fields:
        if f in ("meta", "ext"):
            if x[f"{f}_json"] is not None:
                out[f] = json.loads(x[f"{f}_json"])
        elif x[f] is not None:
            out[f] = x[f]
    return out


def to_json(corpus: Corpus, indent: int | None = 2) -> DataFrame:
    """(doc_id, json): documents as they were read, keys in the format's order, absent keys absent, meta and ext verbatim in value."""
    more = ("meta_json", "ext_json")
    frame = corpus.gathered(("ord", "id", "text", "mode", *more), ("ord", "id", "premises", "conclusions", "justification", "rule", *more), ("version", "name", "description", *more))

    def kernel(d: dict):
        out = {"format": FORMAT, **as_item(d, ["version", "name", "description", "meta", "ext"])}
        out["statements"] = [as_item(x, STATEMENT_FIELDS) for x in d["statements"] or []]
        out["arguments"] = [as_item(x, ARGUMENT_FIELDS) for x in d["arguments"] or []]
        yield d["doc_id"], json.dumps(out, ensure_ascii=False, indent=indent) + ("\n" if indent else "")

    schema = T.StructType([corpus.docs.schema["doc_id"], T.StructField("json", T.StringType())])
    return per_document(frame, kernel, schema)


def write(corpus: Corpus, path: str) -> None:
    """One line of JSON a document."""
    to_json(corpus, None).select(F.col("json").alias("value")).write.text(path)


# Integrity checks over tables that may be broken, by joins.


def duplicate_ids(items: DataFrame) -> DataFrame:
    """(doc_id, ord, id) of later rows with an id that their document has had."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("ord"))
    return items.withColumn("n", rank).filter("n > 1").select("doc_id", "ord", "id")


def unknown_references(corpus: Corpus) -> DataFrame:
    """(doc_id, arg_id, side, pos, ref) of references to statements that the document hasn't."""
    sides = [corpus.arguments.select("doc_id", F.col("id").alias("arg_id"), F.lit(s).alias("side"), F.posexplode(s).alias("pos", "ref")) for s in ("premises", "conclusions")]
    known = corpus.statements.select("doc_id", F.col("id").alias("ref"))
    return sides[0].unionByName(sides[1]).join(known, ["doc_id", "ref"], "left_anti").select("doc_id", "arg_id", "side", "pos", "ref")
