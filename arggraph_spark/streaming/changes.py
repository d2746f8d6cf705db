"""Streams of document versions: each arrival is parsed, validated and compared with the version before it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.net import Net
from ..sources.documents import _strict_json, problems_of

CHANGES = "doc_id string, version long, status string, kind string, id string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (doc_id, version, json) rows from JSON lines in a folder."""
    return spark.readStream.schema("doc_id string, version long, json string").json(path)


def _identities(text: str) -> dict | None:
    try:
        data = _strict_json(text)
    except ValueError:
        return None
    if problems_of(data):
        return None
    net = Net({"statements": data["statements"], "arguments": [{"rule": None, **a} for a in data["arguments"]]})
    prop, just, hashes, _ = net.identities()
    return {"s": [[s["id"], p, j] for s, p, j in zip(net.statements, prop, just, strict=True)], "a": [[a["id"], h] for a, h in zip(net.arguments, hashes, strict=True)]}


def _pairs(old: list, new: list, key: int) -> tuple[list, list, list]:
    """Items of equal key paired by rank, and what is left of each side."""
    waiting: dict[str, list] = {}
    for x in old:
        waiting.setdefault(x[key], []).append(x)
    met, fresh = [], []
    for x in new:
        if waiting.get(x[key]):
            waiting[x[key]].pop(0)
            met.append(x)
        else:
            fresh.append(x)
    return met, [x for rest in waiting.values() for x in rest], fresh


def changes_of(old: dict, new: dict) -> Iterator[tuple[str, str, str]]:
    """(status, kind, id): identical, rejustified, added and removed statements; identical, added and removed arguments."""
    same, gone, fresh = _pairs(old["s"], new["s"], 2)
    again, gone, fresh = (same, *_pairs(gone, fresh, 1))[1:] if (gone or fresh) else ([], [], [])
    for status, rows in (("identical", same), ("rejustified", again), ("added", fresh), ("removed", gone)):
        yield from ((status, "statement", x[0]) for x in rows)
    same, gone, fresh = _pairs(old["a"], new["a"], 1)
    for status, rows in (("identical", same), ("added", fresh), ("removed", gone)):
        yield from ((status, "argument", x[0]) for x in rows)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    version, held = state.get if state.exists else (None, json.dumps({"s": [], "a": []}))
    rows = pd.concat(list(batches)).sort_values("version")
    out = []
    for n, text in zip(rows["version"], rows["json"], strict=True):
        if version is not None and n <= version:
            continue  # late: a newer version was compared already
        new = _identities(text)
        if new is None:
            out.append((key[0], int(n), "invalid", "document", None))
            continue
        out += [(key[0], int(n), *c) for c in changes_of(json.loads(held), new)]
        version, held = int(n), json.dumps(new)
    if version is not None:
        state.update((version, held))
    yield pd.DataFrame(out, columns=["doc_id", "version", "status", "kind", "id"])


def document_changes(stream: DataFrame) -> DataFrame:
    """Changes of each document from version to version, with the last version's identities as state by doc_id.

    Versions that arrive after a newer one are ignored; an invalid document gives one row and leaves the state.
    """
    return stream.groupBy("doc_id").applyInPandasWithState(_step, CHANGES, "version long, identities string", "append", GroupStateTimeout.NoTimeout)


def new_foundations(stream: DataFrame) -> DataFrame:
    """Added statements alone, as a stream."""
    return document_changes(stream).filter((F.col("status") == "added") & (F.col("kind") == "statement"))
