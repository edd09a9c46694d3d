"""Term, prefix, phrase and boolean search and autocompletion over an index."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from lexiquarry.operators.index import Index


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75
    #: "bm25", "tf" (the term frequency) or "zero".
    scoring: str = "bm25"

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must not be negative, and b must be from 0 to 1")
        if self.scoring not in ("bm25", "tf", "zero"):
            raise ValueError(f"unknown scoring {self.scoring!r}")


def _weighed(index: Index, terms: list[str], params: BM25) -> DataFrame:
    """Postings of some terms with their score. What is joined is a row per query term and one of the corpus."""
    hits = index.postings.where(F.col("term").isin(terms))
    if params.scoring != "bm25":
        return hits.withColumn("w", F.col("tf").cast("double") if params.scoring == "tf" else F.lit(0.0))
    hits = hits.join(F.broadcast(index.df_of(terms)), "term").join(F.broadcast(index.corpus_stats()))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") / (1 - params.b + params.b * F.col("doc_len") / F.col("avg_len"))
    return hits.withColumn("w", idf * norm * (params.k1 + 1) / (norm + params.k1))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", (F.col("raw_score") * 1000).cast("int").alias("score"), "raw_score").orderBy(F.desc("raw_score"), "doc_id")


def exists(index: Index, term: str) -> DataFrame:
    """One row: does the word occur."""
    return index.postings.where(F.col("term") == term.lower()).limit(1).agg((F.count("*") > 0).alias("found"))


def exact_tf(index: Index, term: str) -> DataFrame:
    return index.postings.where(F.col("term") == term.lower()).select("doc_id", "tf")


def exact_docs(index: Index, term: str) -> DataFrame:
    return exact_tf(index, term).select("doc_id", F.lit(1).alias("count"))


def exact(index: Index, term: str, params: BM25 = BM25()) -> DataFrame:
    """doc_id, score, raw_score, best first."""
    return _ranked(_weighed(index, [term.lower()], params).select("doc_id", F.col("w").alias("raw_score")))


def max_doc(index: Index, term: str) -> DataFrame:
    """The largest doc_id with the term, or -1."""
    return index.postings.where(F.col("term") == term).agg(F.coalesce(F.max("doc_id"), F.lit(-1).cast("long")).alias("max_doc"))


def prefix_rows(index: Index, prefix: str) -> DataFrame:
    """term and doc_id of the words that begin so; the form for words of any frequency."""
    return index.postings.where(F.col("term").startswith(prefix.lower())).select("term", "doc_id")


def prefix_words(index: Index, prefix: str) -> DataFrame:
    """Words that begin so, each with the list of its documents, which is as long as the word is common."""
    return prefix_rows(index, prefix).groupBy("term").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))


def prefix_docs(index: Index, prefix: str) -> DataFrame:
    return index.postings.where(F.col("term").startswith(prefix.lower())).select("doc_id").distinct()


def trie_node_exists(index: Index, prefix: str) -> DataFrame:
    """One row: would the prefix end on a node of a radix trie of the vocabulary."""
    p = prefix.lower()
    own = index.postings.where(F.col("term").startswith(p)).select("term").distinct()
    following = F.countDistinct(F.expr(f"nullif(substring(term, {len(p) + 1}, 1), '')"))
    return own.agg((F.coalesce(F.max((F.col("term") == p).cast("int")), F.lit(0)) + (following >= 2).cast("int") > 0).alias("is_node"))


def trie_nodes(index: Index) -> DataFrame:
    """One row: nodes of a radix trie of the vocabulary, the root included."""
    words = index.postings.select("term").distinct()
    parts = words.select("term", F.explode(F.sequence(F.lit(1), F.length("term"))).alias("n"))
    parts = parts.select(F.expr("substring(term, 1, n)").alias("p"), F.expr("nullif(substring(term, n + 1, 1), '')").alias("c"))
    per = parts.groupBy("p").agg(F.count_distinct("c").alias("k"), F.max(F.col("c").isNull()).alias("word"))
    return per.where("word or k >= 2").agg((F.count("*") + 1).alias("nodes"))


def phrase(index: Index, query: str, params: BM25 = BM25()) -> DataFrame:
    """Documents with the words side by side; 1.2 times the sum of the words' scores. One shuffle, by document."""
    words = [w for w in query.lower().split(" ") if w]
    if len(words) < 2:
        return exact(index, words[0] if words else "", params)
    rows = _weighed(index, list(dict.fromkeys(words)), params)
    matched = _phrase_rows(rows, words)
    total = sum((F.col(f"w{k}") for k in range(1, len(words))), F.col("w0"))
    return _ranked(matched.select("doc_id", (F.lit(1.2) * total).alias("raw_score")))


def _phrase_rows(rows: DataFrame, words: list[str]) -> DataFrame:
    slots = [F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{k}") for k, w in enumerate(words)]
    weights = [F.max(F.when(F.col("term") == w, F.col("w"))).alias(f"w{k}") for k, w in enumerate(words)] if "w" in rows.columns else []
    out = rows.groupBy("doc_id").agg(*slots, *weights)
    at = F.col("p0")
    for k in range(1, len(words)):
        at = F.array_intersect(F.transform(at, lambda x: x + 1), F.col(f"p{k}"))
    return out.where(F.size(at) > 0)


def phrase_count(index: Index, query: str) -> DataFrame:
    """Documents of a phrase, with the number of merges, which is one less than that of its words; by count, then doc_id."""
    words = [w for w in query.lower().split(" ") if w]
    rows = index.postings.where(F.col("term").isin(words))
    return _phrase_rows(rows, words).select("doc_id", F.lit(max(len(words) - 1, 1)).alias("count")).orderBy(F.desc("count"), "doc_id")


def parse_boolean(query: str) -> list[tuple[str | None, str]]:
    """(operator before it, operand), left to right. The last of several operators counts; None: no operator."""
    out: list[tuple[str | None, str]] = []
    op = None
    for token in query.lower().split():
        if token in ("&&", "||"):
            op = token
        else:
            out.append((op if out else None, token))
            op = None
    return out


def boolean(index: Index, query: str, params: BM25 = BM25()) -> DataFrame:
    """Left to right, without precedence. An operand without an operator only adds to the score, as every listed one does."""
    parts = parse_boolean(query)
    if not parts:
        return _ranked(index.postings.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("raw_score")))
    terms = list(dict.fromkeys(t for _, t in parts))
    rows = _weighed(index, terms, params).groupBy("doc_id").agg(*[F.max(F.when(F.col("term") == t, F.col("w"))).alias(f"w{k}") for k, t in enumerate(terms)])
    has = {t: F.col(f"w{k}").isNotNull() for k, t in enumerate(terms)}
    match = has[parts[0][1]]
    for op, t in parts[1:]:
        match = match & has[t] if op == "&&" else match | has[t] if op == "||" else match
    own = [F.coalesce(F.col(f"w{terms.index(t)}"), F.lit(0.0)) for _, t in parts]
    return _ranked(rows.where(match).select("doc_id", sum(own[1:], own[0]).alias("raw_score")))


def boolean_sets(index: Index, query: str) -> DataFrame:
    """Documents of a boolean query by set operations: another plan for the same matches, where each operand has an operator."""
    of = lambda t: index.postings.where(F.col("term") == t).select("doc_id")
    parts = [p.strip() for p in re.split(r"(&&|\|\|)", query.lower()) if p.strip()]
    while parts and parts[0] in ("&&", "||"):
        parts = parts[1:]
    while parts and parts[-1] in ("&&", "||"):
        parts = parts[:-1]
    out, op = of(parts[0]), None
    for p in parts[1:]:
        if p in ("&&", "||"):
            op = p
        else:
            out = out.intersect(of(p)) if op == "&&" else out.union(of(p)).distinct()
    return out


def bitmaps(index: Index) -> DataFrame:
    """term, bucket and bitmap of the documents with the term."""
    rows = index.postings.select("term", F.bitmap_bucket_number("doc_id").alias("bucket"), F.bitmap_bit_position("doc_id").alias("bit"))
    return rows.groupBy("term", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def bitmap_counts(index: Index, terms: list[str]) -> DataFrame:
    """Documents of each term, counted from bitmaps."""
    return bitmaps(index).where(F.col("term").isin(terms)).groupBy("term").agg(F.sum(F.bitmap_count("bits")).alias("n_docs"))


def common_prefix(word: Column, query: str) -> Column:
    return F.greatest(F.lit(0), F.lit(0), *[F.when(word.startswith(query[:i]), F.lit(i)).otherwise(0) for i in range(1, len(query) + 1)])


def autocomplete(index: Index, query: str, k: int | None = 20) -> DataFrame:
    """rank, term, df: words with the prefix or, failing that, those that share most of it, 60 % of the query at least.

    One pass in place of a search for ever shorter prefixes: what such a search
    finds first are the words of the longest common prefix. Words that share
    too little are not counted.
    """
    q = query.strip().lower()
    q = q.split(" ")[-1] if q else q
    dfs = index.dfs()
    if not q:
        return dfs.where(F.lit(False)).select(F.lit(1).alias("rank"), "term", "df")
    least = len(q) if len(q) <= 2 else max(2, math.ceil(0.6 * len(q) - 1e-9))
    hits = dfs.where(F.col("term").startswith(q[:least]))
    if least < len(q):
        near = hits.withColumn("lcp", common_prefix(F.col("term"), q))
        best = near.agg(F.max(F.struct("lcp", "df")).alias("m")).select(F.col("m.lcp").alias("top"))  # df too: else words would be counted once for this and once for the hits
        hits = near.join(F.broadcast(best), F.col("lcp") == F.col("top"))
    top = hits.orderBy(F.desc("df"), F.length("term"), "term")
    top = top.limit(k) if k is not None else top
    rank = F.row_number().over(Window.orderBy(F.desc("df"), F.length("term"), "term"))
    return top.select(rank.alias("rank"), "term", "df")


def hydrate(index: Index, hits: DataFrame) -> DataFrame:
    """Titles beside the ids; hits without a document keep a null title."""
    return hits.join(index.documents.select("doc_id", "title"), "doc_id", "left")
