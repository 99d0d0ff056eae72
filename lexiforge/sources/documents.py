"""Raw documents (provider, word, doc_kind, body) to entries, trees and paradigms: one pass in Arrow batches for each kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexiforge.functions import dom
from lexiforge.schema import INFLECTION, NODE, PARADIGM, entry_type
from lexiforge.sources import parsers

#: Documents parsed before their rows are handed on, which bounds what a task holds.
STEP = 64


def _each(docs: DataFrame, make: Callable[[dict], Iterator[dict]], schema: T.StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for low in range(0, len(x), STEP):
                rows = [r for d in x.slice(low, STEP).to_pylist() for r in make(d)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return docs.mapInArrow(run, schema)


def read_entries(docs: DataFrame) -> DataFrame:
    """word and the columns of schema.ENTRY. A document that cannot be read gives no rows; see errors()."""
    schema = T.StructType([T.StructField("word", T.StringType()), *entry_type().fields])

    def make(d: dict) -> Iterator[dict]:
        try:
            yield from [{"word": d["word"], **e} for e in parsers.entries_of(d["provider"], d["word"], d["body"])]
        except (KeyError, TypeError, ValueError, AttributeError, IndexError, RecursionError):
            return  # one bad document does not stop the others; errors() lists it

    return _each(docs.select("provider", "word", "body"), make, schema)


def errors(docs: DataFrame) -> DataFrame:
    """provider, word and message of documents whose parser failed."""

    def make(d: dict) -> Iterator[dict]:
        try:
            list(parsers.entries_of(d["provider"], d["word"], d["body"]))
        except (KeyError, TypeError, ValueError, AttributeError, IndexError, RecursionError) as e:
            yield {"provider": d["provider"], "word": d["word"], "message": f"{type(e).__name__}: {e}"}

    return _each(docs.select("provider", "word", "body"), make, T.StructType.fromDDL("provider string, word string, message string"))


def read_trees(pages: DataFrame) -> DataFrame:
    """word, tree_ord, pos_info, nodes of pages (word, body)."""
    schema = T.StructType.fromDDL(f"word string, tree_ord int, pos_info string, nodes array<{NODE}>")
    return _each(pages.select("word", "body"), lambda d: ({"word": d["word"], "tree_ord": i, **t} for i, t in enumerate(parsers.meaning_trees(d["body"] or ""))), schema)


def read_paradigms(pages: DataFrame) -> DataFrame:
    """word, paradigm_ord, lexeme, label, pos_info, paradigm, inflections of pages (word, body)."""
    schema = T.StructType.fromDDL(f"word string, paradigm_ord int, lexeme string, label string, pos_info string, paradigm {PARADIGM}, inflections array<{INFLECTION}>")
    return _each(pages.select("word", "body"), lambda d: ({"word": d["word"], "paradigm_ord": i, **p} for i, p in enumerate(parsers.paradigms(d["body"] or ""))), schema)


def html_text(html: Column) -> Column:
    """The text of HTML pages by a real parser; a reference without its semicolon is text, as in plain_text."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda page: dom.page_text(page, closed=True), na_action="ignore")

    return run(html)


_INFO = "struct<url:string,mime:string,extmetadata:struct<LicenseShortName:struct<value:string>,Artist:struct<value:string>>>"


def read_recordings(replies: DataFrame) -> DataFrame:
    """word, url, mime, license, attribution, file: the first page with a file of each reply (word, body) of a media archive."""
    page = f"struct<title:string,missing:boolean,imageinfo:array<{_INFO}>>"
    pages = F.from_json("body", f"query struct<pages:array<{page}>>")["query"]["pages"]
    url = lambda p: F.get(p["imageinfo"], F.lit(0))["url"]
    found = F.get(F.filter(pages, lambda p: p["missing"].isNull() & (F.coalesce(url(p), F.lit("")) != "")), F.lit(0))
    rows = replies.select("word", found.alias("p")).filter("p IS NOT NULL").select("word", "p.title", F.get("p.imageinfo", F.lit(0)).alias("i"))
    plain = lambda c, other: F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "\\s+", " ")), F.lit("")), F.lit(other))
    meta = "i.extmetadata."
    return rows.select(
        "word", "i.url", F.coalesce("i.mime", F.lit("application/ogg")).alias("mime"), plain(F.col(f"{meta}LicenseShortName.value"), "unknown").alias("license"),
        plain(F.col(f"{meta}Artist.value"), "Wikimedia Commons contributors").alias("attribution"), F.coalesce("title", F.lit("")).alias("file"),
    )


def exact_titles(hits: DataFrame) -> DataFrame:
    """word and title of the first hit (word, title, place) of each word whose name ends with the word itself."""
    name = F.lower(F.regexp_replace("title", "\\.[A-Za-z0-9]+$", ""))
    ends = name.endswith(F.concat(F.lit("-"), F.lower("word"))) | name.endswith(F.concat(F.lit("_"), F.lower("word")))
    return hits.filter(ends & F.col("title").rlike("\\.[A-Za-z0-9]+$")).groupBy("word").agg(F.min_by("title", "place").alias("title"))
