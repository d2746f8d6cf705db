"""HTML pages as tagged text: headings open lines with a mark, paragraphs carry a citation key of their part and number."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse

HEADINGS = ("h1", "h2", "h3")
BLOCKS = (*HEADINGS, "p", "div", "pre")

#: What a page is cut into: comments, scripts and styles as a whole, tags with quoted attributes, declarations, text.
_PIECES = r"""(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|</?[a-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|<[!?][^>]*>|[^<]+|<"""
_VERBATIM = r"(?is)^<(?:script|style)\b[^>]*>(.*)</(?:script|style)\s*>$"
_BLOCK = f"(?i)^</?({'|'.join(BLOCKS)})(?:[\\s/].*)?>$"


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def _events(page: Column) -> Column:
    """The page as an array of (block, open, text): a block's start or end, or text, which has no block."""
    piece = lambda x: F.regexp_replace(x, "\\s+", " ")  # noqa: E731  so that . meets every character of a tag
    block = lambda x: F.lower(F.regexp_extract(piece(x), _BLOCK, 1))
    said = lambda x: F.when(~x.startswith("<") | (x == "<"), x).when(x.rlike(r"(?i)^<br[\s/>]"), " ").when(x.rlike(_VERBATIM), F.regexp_extract(x, _VERBATIM, 1))
    pieces = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(_PIECES), F.lit(0))
    events = F.transform(pieces, lambda x: F.struct(block(x).alias("block"), (~x.startswith("</")).alias("open"), said(x).alias("text")))
    return F.filter(events, lambda e: (e["block"] != "") | e["text"].isNotNull())


def blocks(page: Column) -> Column:
    """The closed blocks of a page, an array of (tag, text) in the order they close; null has none.

    Text counts for the innermost open block. An end that isn't that of the innermost open block is passed over. This is
    a fold over the page's events in the plan; character references are resolved by the caller.
    """
    kind = "array<struct<tag:string,text:string>>"
    none = F.array().cast(kind)

    def step(state: Column, e: Column) -> Column:
        held, n = state["held"], F.size(state["held"])
        top = F.try_element_at(held, F.lit(-1))
        below = F.slice(held, F.lit(1), F.greatest(n - 1, F.lit(0)))
        entered = F.array_append(held, F.struct(e["block"].alias("tag"), F.lit("").alias("text")))
        told = F.array_append(below, F.struct(top["tag"].alias("tag"), F.concat(top["text"], e["text"]).alias("text")))
        ends = (e["block"] != "") & ~e["open"] & (top["tag"] == e["block"])
        now = F.when((e["block"] != "") & e["open"], entered).when(ends, below).when((e["block"] == "") & (n > 0), told).otherwise(held)
        return F.struct(now.alias("held"), F.when(ends, F.array_append(state["closed"], top)).otherwise(state["closed"]).alias("closed"))

    return F.aggregate(_events(page), F.struct(none.alias("held"), none.alias("closed")), step, lambda s: s["closed"])


def _resolved(text: Column) -> Column:
    """Character references as characters; texts without any don't go to Python."""
    return F.coalesce(_unescaped(F.when(F.contains(text, F.lit("&")), text)), text)


def tagged_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", part: Column | None = None) -> DataFrame:
    """(doc_id, n, tag, text, line) of the headings and paragraphs that have text.

    A heading is "# text". A paragraph is "[PART.k] text", k counting the part's paragraphs; before the first part it
    is its text alone. ``part`` (of ``text`` and ``nth``, the heading's number) names the part that a heading opens, or
    is null where it opens none; by default every heading opens one, named by its number.
    """
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(blocks(F.col(html_col))).alias("n", "b")).select("doc_id", "n", "b.tag", collapse(_resolved(F.col("b.text"))).alias("text"))
    rows = rows.filter((F.col("text") != "") & F.col("tag").isin(*HEADINGS, "p"))
    order = Window.partitionBy("doc_id").orderBy("n")
    title = F.col("tag").isin(*HEADINGS)
    rows = rows.withColumn("title", title).withColumn("nth", F.when(title, F.count_if(F.col("title")).over(order)))
    rows = rows.withColumn("opens", F.when(title, part if part is not None else F.col("nth").cast("string")))
    rows = rows.withColumns({"part": F.last("opens", True).over(order), "of": F.count("opens").over(order)})
    k = F.count_if(~F.col("title")).over(Window.partitionBy("doc_id", "of").orderBy("n"))
    line = F.when(title, F.concat(F.lit("# "), "text")).when(F.col("part").isNull(), F.col("text")).otherwise(F.concat(F.lit("["), "part", F.lit("."), k.cast("string"), F.lit("] "), "text"))
    return rows.select("doc_id", "n", "tag", "text", line.alias("line"))


def tagged_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", part: Column | None = None) -> DataFrame:
    """(doc_id, text) of every page: its lines with blank lines between, as the segmentation of text reads them."""
    lines = tagged_blocks(pages, id_col, html_col, part).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    every = pages.select(F.col(id_col).alias("doc_id")).distinct()
    return every.join(lines, "doc_id", "left").select("doc_id", F.when(F.col("l").isNull(), "").otherwise(F.concat(F.array_join(F.col("l.line"), "\n\n"), F.lit("\n"))).alias("text"))
