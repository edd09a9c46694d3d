"""One object over an index: the query surface of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lexiquarry.functions import display
from lexiquarry.functions.analysis import Filter, tokenize
from lexiquarry.operators import bloom, index as ix, search
from lexiquarry.operators.search import BM25
from lexiquarry.plans import query as qp


class TextIndex:
    """Every method returns a lazy DataFrame, or a new TextIndex where the index changes."""

    def __init__(self, index: ix.Index, analyze: Filter = tokenize, params: BM25 = BM25()):
        self.index, self.analyze, self.params = index, analyze, params
        self._bloom: bloom.Bloom | None = None
        self.operations: dict[str, Callable[[str], DataFrame]] = {
            "exact": lambda q: search.exists(self.index, q),
            "prefixdocs": lambda q: search.prefix_docs(self.index, q),
            "autocomplete": lambda q: search.autocomplete(self.index, q),
            "fulltext": lambda q: self.full_text(q),
            "bloom": lambda q: self.might_contain(q),
        }

    @staticmethod
    def build(documents: DataFrame, analyze: Filter = tokenize, params: BM25 = BM25()) -> TextIndex:
        return TextIndex(ix.build(documents, analyze), analyze, params)

    def with_params(self, k1: float = 1.2, b: float = 0.75, scoring: str = "bm25") -> TextIndex:
        return TextIndex(self.index, self.analyze, BM25(k1, b, scoring))

    def full_text(self, q: str) -> DataFrame:
        plan = qp.route(q.replace("*", ""))
        return {"boolean": search.boolean, "phrase": search.phrase, "exact": search.exact}[plan.kind](self.index, plan.text, self.params)

    def run(self, operation: str, q: str) -> DataFrame:
        """An operation by name, in any case. Autocompletion sees the query as it is."""
        name = operation.lower()
        if name not in self.operations:
            raise ValueError(f"unknown operation {operation!r}")
        return self.operations[name](q if name == "autocomplete" else qp.normalize(q))

    def search(self, q: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Documents of a query with titles and snippets, best first; these are made after offset and limit."""
        if not q.strip():
            raise ValueError("the query is blank")
        plan = qp.route(q)
        if plan.kind == "prefix":
            hits = search.prefix_docs(self.index, plan.text).select("doc_id", F.lit(None).cast("int").alias("score"), F.lit(None).cast("double").alias("raw_score"))
        else:
            hits = self.full_text(q)
        if limit is not None or offset:
            hits = hits.orderBy(F.desc("raw_score"), "doc_id").offset(offset)
            hits = hits.limit(limit) if limit is not None else hits
        out = hits.join(self.index.documents, "doc_id", "left")
        snippet = display.snippet(F.col("content"), F.col("title"), plan.text, plan.kind)
        return out.select("doc_id", "title", snippet.alias("snippet"), "score", "raw_score").orderBy(F.desc("raw_score"), "doc_id")

    def response(self, q: str, limit: int | None = None, offset: int = 0) -> dict:
        """What a service answers: a page of results (``limit`` rows), all hits counted, the query, its kind and the parameters.

        The results are a DataFrame with id, title, snippet and score, tenths with one decimal.
        """
        plan = qp.route(q)
        hits = search.prefix_docs(self.index, plan.text) if plan.kind == "prefix" else self.full_text(q)
        page = self.search(q, limit, offset).select(F.col("doc_id").cast("string").alias("id"), "title", "snippet", F.round(F.col("score") / 10, 1).alias("score"))
        return {"results": page, "totalCount": hits.count(), "query": q, "operation": qp.label(q), "parameters": {"k1": self.params.k1, "b": self.params.b}}

    def last_word_exists(self, q: str) -> DataFrame:
        """One row: does the last word of what is being typed occur."""
        words = q.split()
        return search.exists(self.index, qp.first_word(words[-1]) if words else "")

    def document(self, title: str, q: str | None = None) -> DataFrame:
        """A document by title, highlighted for a query; of several, the lowest id."""
        one = self.index.documents.where(F.col("title") == title).orderBy("doc_id").limit(1)
        if q:
            plan = qp.route(q)
            one = one.withColumn("content", display.highlight(F.col("content"), plan.text, plan.kind))
        return one.select("title", "content")

    def title_of(self, doc_id: int) -> DataFrame:
        return self.index.documents.where(F.col("doc_id") == doc_id).orderBy("title").limit(1).select("title")

    def content_of(self, doc_id: int) -> DataFrame:
        return self.index.documents.where(F.col("doc_id") == doc_id).orderBy("content").limit(1).select("content")

    def autocomplete(self, q: str, k: int = 20) -> DataFrame:
        return search.autocomplete(self.index, q, k)

    def might_contain(self, q: str) -> DataFrame:
        """One row from the Bloom filter, which is built at the first call."""
        if self._bloom is None:
            self._bloom = bloom.build(self.index.postings.select("term").distinct())
        spark = self.index.postings.sparkSession
        return spark.createDataFrame([(qp.first_word(q) in self._bloom,)], "found boolean")

    def add(self, documents: DataFrame) -> TextIndex:
        return TextIndex(ix.upsert(self.index, documents, self.analyze), self.analyze, self.params)

    def remove(self, ids: DataFrame) -> TextIndex:
        return TextIndex(ix.remove(self.index, ids), self.analyze, self.params)

    def rebuild(self) -> TextIndex:
        return TextIndex(ix.rebuild(self.index), self.analyze, self.params)

    def clear(self) -> TextIndex:
        return TextIndex(ix.clear(self.index), self.analyze, self.params)
