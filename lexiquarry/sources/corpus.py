"""Readers and writers: delimited corpus files, wiki JSON, compressed contents, CSV."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lexiquarry.functions.analysis import clean_markup

MARKER = "---END.OF.DOCUMENT---"
_WIKI = "$.query.pages[0].revisions[0].slots.main.content"


def parse_corpus(text: str, flush_tail: bool = False, keep_blank: bool = True) -> list[tuple[str, str]]:
    """(title, content) of a delimited file: a title line, content lines, a marker line.

    A document without content lines is left out, and so is one that the file
    ends in before its marker, unless ``flush_tail``. A marker where a title is
    due becomes the title.
    """
    out: list[tuple[str, str]] = []
    title, body = None, []

    def close() -> None:
        content = "\n".join(body).strip()
        if title is not None and body and (keep_blank or content):
            out.append((title, content))

    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for line in (x.removesuffix("\r") for x in lines):
        if title is None:
            if line.strip():
                title = line
        elif line.strip() == MARKER:
            close()
            title, body = None, []
        elif keep_blank or line.strip():
            body.append(line)
    if flush_tail:
        close()
    return out


def read_corpus(spark: SparkSession, path: str, flush_tail: bool = False, keep_blank: bool = True) -> DataFrame:
    """doc_id, title, content of the files at ``path``; ids from 0, by file and place.

    A file is read by one task, since only its start tells titles from contents.
    """

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows = [(name, k, t, c) for k, (t, c) in enumerate(parse_corpus(value, flush_tail, keep_blank))]
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["file", "at", "title", "content"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    docs = files.mapInArrow(parse, "file string, at long, title string, content string")
    # numbers by file: offsets are summed over files, not over documents
    sizes = docs.groupBy("file").agg(F.count("*").alias("n"))
    sizes = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    return docs.join(sizes, "file").select((F.col("base") + F.col("at")).alias("doc_id"), "title", "content")


def wiki_content(json: Column, clean: bool = True) -> Column:
    """An article's text from a query response; null if any level is missing."""
    text = F.get_json_object(json, _WIKI)
    return clean_markup(text) if clean else text


def next_ids(documents: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ids after the largest in ``documents``; ids are unique and ordered by place, not gapless."""
    top = documents.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("top"))
    return new.join(F.broadcast(top)).select((F.col("top") + 1 + F.monotonically_increasing_id()).alias("doc_id"), *new.columns)


def update_content(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Contents replaced by those of ``changes(doc_id, content)``; unknown ids change nothing, and of several contents for an id the last in order counts."""
    new = changes.groupBy("doc_id").agg(F.max("content").alias("new"), F.lit(True).alias("hit"))
    out = documents.join(new, "doc_id", "left")
    return out.withColumn("content", F.when(F.col("hit"), F.col("new")).otherwise(F.col("content"))).select(*documents.columns)


@F.pandas_udf(T.BinaryType())
def compress(text: pd.Series) -> pd.Series:
    """gzip of the UTF-8; null and empty texts give an empty value."""
    return text.map(lambda t: gzip.compress(t.encode(), mtime=0) if t else b"")


@F.pandas_udf(T.StringType())
def decompress(data: pd.Series) -> pd.Series:
    return data.map(lambda b: gzip.decompress(bytes(b)).decode() if b else "")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
