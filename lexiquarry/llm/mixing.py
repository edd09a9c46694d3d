"""Mixing sources by temperature.

A source with token share p gets weight p ** a / sum(p ** a). The exponent a
is searched between 0 (equal weights) and 1 (natural shares): the largest that
meets a target entropy, or the smallest that meets a repetition limit.

A source's part of the token budget is its weight; without a budget it is the
least at which no source loses a document, so the source of most tokens for its
weight is passed once and others up to ``repeats`` times. A source's documents
lie in blocks of about ``ROWS``, by a hash of their content. Each pass uses the
blocks in a permuted order of its own, and the documents of a block in another;
the last, partial pass goes on while its tokens are within the source's part.

All of it is DataFrame expressions: shares and prefix sums are aggregates, and
prefix sums are taken within a block and over the blocks of a pass, so no task
holds a source. Rows equal in doc_id, source and text are counted together
before any of this and used alike. The driver sees one row per trial exponent.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexiquarry.llm.scratch import Scratch

ROWS = 4096
_CELLS, _ROUNDS = 64, 5
_NAME = "md5(concat(coalesce(cast(doc_id as string), ''), ':', coalesce(cast(source as string), ''), ':', coalesce(cast(text as string), '')))"
_SPAN = 1 << 52


def _number(text: str) -> str:
    """52 bits of an md5 digest."""
    return f"cast(conv(substr({text}, 1, 13), 16, 10) as long)"


def _search(shares: DataFrame, entropy: float | None, repeats: float) -> float:
    """The exponent; each round looks at the ends of 64 cells of the interval, six halvings at once."""
    low, high = 0.0, 1.0
    for _ in range(_ROUNDS):
        trials = [low + (high - low) * k / _CELLS for k in range(_CELLS + 1)]
        grid = shares.where("p > 0").select("p", F.posexplode(F.array(*map(F.lit, trials))).alias("k", "a"))
        z, zl = F.sum(F.expr("pow(p, a)")), F.sum(F.expr("pow(p, a) * a * ln(p)"))
        got = {r["k"]: r for r in grid.groupBy("k").agg(z.alias("z"), zl.alias("zl"), F.max("p").alias("hi"), F.min("p").alias("lo")).collect()}
        if not got:
            return 1.0
        if entropy is not None:
            # entropy falls as a rises: the last trial that meets it
            fit = [k for k in range(_CELLS + 1) if math.log(got[k]["z"]) - got[k]["zl"] / got[k]["z"] >= entropy]
            k = max(fit, default=0)
            low, high = trials[k], trials[min(k + 1, _CELLS)]
        else:
            # repeats fall as a rises: the first trial within the limit
            fit = [k for k in range(_CELLS + 1) if (got[k]["hi"] / got[k]["lo"]) ** (1 - trials[k]) <= repeats]
            k = min(fit, default=_CELLS)
            low, high = trials[max(k - 1, 0)], trials[k]
    return low if entropy is not None else high


def _used(spark: SparkSession, docs: DataFrame, entropy: float | None, repeats: float, budget: float | None) -> DataFrame:
    """name, doc_id, source, n_tokens, times (equal rows), weight, pass, block and position of the first of them."""
    if repeats < 1:
        raise ValueError("repeats must be 1 or more")
    if budget is not None and budget < 0:
        raise ValueError("budget must not be negative")
    scratch = Scratch(spark)
    slim = docs.select(
        F.expr(_NAME).alias("name"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.expr(r"cast(regexp_count(coalesce(cast(text as string), ''), '[^\\x20\\x09-\\x0D]+') as long)").alias("n_tokens"),
    )
    slim = scratch.keep(slim.groupBy("name", "doc_id", "source", "n_tokens").agg(F.count("*").alias("times")).withColumn("key", F.expr("coalesce(concat('=', source), '')")))
    totals = slim.groupBy("key").agg(F.sum(F.expr("n_tokens * times")).alias("t"), F.sum("times").alias("n"))
    whole = totals.agg(F.sum("t")).collect()[0][0] or 0
    shares = scratch.keep(totals.withColumn("p", F.col("t") / F.lit(float(max(whole, 1)))))
    a = _search(shares, entropy, repeats)
    z, top = shares.where("p > 0").agg(F.sum(F.expr(f"pow(p, {a!r}D)")), F.max("p")).collect()[0]
    z, top = z or 1.0, top or 1.0
    weight = F.when(F.col("p") > 0, F.expr(f"pow(p, {a!r}D) / {z!r}D")).otherwise(0.0)
    # how often its part of the budget passes the source
    r = F.expr(f"pow({top!r}D / p, {1 - a!r}D)") if budget is None else weight * F.lit(float(budget)) / F.col("t")
    plan = shares.select("key", weight.alias("weight"), F.when(F.col("p") > 0, r).otherwise(1.0).alias("r"), "t", "n", F.ceil(F.col("n") / ROWS).alias("blocks"))
    plan = plan.withColumn("whole", F.floor("r")).withColumn("rest", (F.col("r") - F.floor("r")) * F.col("t")).drop("r", "t")
    plan = plan.where("whole > 0 or rest > 0").withColumn("passes", F.expr("explode(sequence(0L, whole - if(rest > 0, 0, 1)))")).withColumnRenamed("passes", "pass")
    rows = slim.join(plan, "key").withColumn("block", F.floor(F.expr(_number("name")) / float(_SPAN) * F.col("blocks")))
    rows = rows.withColumn("at", F.expr(_number("md5(concat(name, ':', pass))")))
    cut = rows.groupBy("key", "pass", "block").agg(F.sum(F.expr("n_tokens * times")).alias("own"), F.sum("times").alias("lines"))
    cut = cut.withColumn("turn", F.expr("md5(concat(pass, ':', block, ':', key))"))
    order = Window.partitionBy("key", "pass").orderBy("turn", "block")
    cut = cut.select("key", "pass", "block", (F.sum("own").over(order) - F.col("own")).alias("before"), (F.sum("lines").over(order) - F.col("lines")).alias("ahead"))
    rows = rows.join(cut, ["key", "pass", "block"])
    within = Window.partitionBy("key", "pass", "block").orderBy("at", "name", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.col("before") + F.sum(F.expr("n_tokens * times")).over(within) - F.expr("n_tokens * times"))
    rows = rows.withColumn("position", F.col("pass") * F.col("n") + F.col("ahead") + F.sum("times").over(within) - F.col("times"))
    rows = rows.where("pass < whole or start < rest")
    return rows.select("name", "doc_id", "source", "n_tokens", "times", F.round("weight", 6).alias("weight"), F.col("pass").cast("int").alias("pass"), "block", "position")


def mix(spark: SparkSession, docs: DataFrame, entropy: float | None = None, repeats: float = 2.0, budget: float | None = None) -> DataFrame:
    """One row per use: doc_id, source, n_tokens, weight, pass, block and position among the uses of its source.

    ``docs`` needs doc_id, source and text; tokens are words between ASCII
    white space. ``repeats`` limits how often any source is passed, unless a
    target ``entropy`` (natural logarithm) of the weights is given. ``budget``
    is in tokens; without one every row is used once at least.

    A null source is a source of its own; null, empty and blank texts have no
    tokens; sources without tokens have weight 0 and are used once. Rows equal
    in doc_id, source and text (null counts as empty) are used alike, side by
    side; rows that share only a doc_id, or have none, are rows of their own.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = _used(spark, docs, entropy, repeats, budget)
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(0L, times - 1)"))).withColumn("position", F.col("position") + F.col("copy"))
    return rows.select("doc_id", "source", "n_tokens", "weight", "pass", "block", "position")


def expand(spark: SparkSession, docs: DataFrame, entropy: float | None = None, repeats: float = 2.0, budget: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` uses it; rows that it does not use are left out."""
    uses = _used(spark, docs, entropy, repeats, budget).groupBy("name").agg(F.count("*").alias("uses"))
    every = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*every).alias("row"), F.expr(_NAME).alias("name"))
    return named.join(uses, "name").withColumn("uses", F.expr("explode(sequence(1L, uses))")).select("row.*")


#: ``mix`` with a limit of two passes, for DuckDB.
SQL = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(source, ''), ':', coalesce(text, ''))) AS name, coalesce('=' || source, '') AS key FROM documents),
  s AS (SELECT key, sum(n_tokens) AS t, count(*) AS n, ceil(count(*) / {ROWS}.0)::BIGINT AS blocks FROM d GROUP BY key),
  p AS (SELECT *, t / (SELECT sum(t) FROM s)::DOUBLE AS p FROM s),
  e AS (SELECT max(p) AS top, CASE WHEN max(p) / min(p) <= 2 THEN 0 ELSE ceil((1 - ln(2) / ln(max(p) / min(p))) * {2**30}) / {2**30} END::DOUBLE AS a FROM p WHERE p > 0),
  w AS (SELECT key, t, n, blocks, CASE WHEN p > 0 THEN pow(p, a) / (SELECT sum(pow(p, a)) FROM p, e WHERE p > 0) ELSE 0 END AS weight,
    CASE WHEN p > 0 THEN pow(top / p, 1 - a) ELSE 1 END AS r FROM p, e),
  c AS (SELECT *, floor(r)::BIGINT AS whole, (r - floor(r)) * t AS rest FROM w),
  u AS (SELECT *, unnest(range(whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END))::INT AS pass FROM c),
  x AS (SELECT d.*, weight, pass, n, whole, rest, floor(('0x' || substr(name, 1, 13))::BIGINT / {_SPAN}::DOUBLE * blocks)::BIGINT AS block,
    ('0x' || substr(md5(concat(name, ':', pass)), 1, 13))::BIGINT AS place FROM d JOIN u USING (key)),
  y AS (SELECT *, md5(concat(pass, ':', block, ':', key)) AS turn FROM x),
  z AS (SELECT *, sum(n_tokens) OVER o - n_tokens AS start, pass * n + row_number() OVER o - 1 AS position FROM y
    WINDOW o AS (PARTITION BY key, pass ORDER BY turn, block, place, name ROWS UNBOUNDED PRECEDING))
  SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, pass, block, position::BIGINT AS position FROM z WHERE pass < whole OR start < rest"""
