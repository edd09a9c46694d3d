"""Quality rules: a learned decision list over text statistics, all in Spark expressions.

Statistics are computed per text by built-in functions. From the statistics of
a bounded sample of labelled texts, sequential covering learns rules for poor
texts: a rule is grown condition by condition for the largest FOIL gain, pruned
on rows held back from growing, and kept if it is precise there; the rows it
covers are removed and the next rule is grown. The list is emitted as one
ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows to learn from, at most, and conditions and rules of a list.
SAMPLE, CONDITIONS, RULES = 6000, 4, 16
#: The share of poor texts among the held-back rows that a rule covers.
PRECISION = 0.95

# as they stand in a SQL literal
_BLANKS = r"[\\x20\\x09-\\x0D]+"
_BLANK_CHARS = r"' \t\n\u000b\u000c\r'"
#: What rules look at: names and expressions over the statistics.
MEASURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "shout_share": "n_marks / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    measure: str
    at_least: bool
    limit: float

    def holds(self, row: dict) -> bool:
        return row[self.measure] >= self.limit if self.at_least else row[self.measure] <= self.limit

    def sql(self) -> str:
        return f"({MEASURES[self.measure]}) {'>=' if self.at_least else '<='} cast({self.limit!r} as double)"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text; a null text counts as empty.

    A five-word window is compared by a 64-bit hash of its words. Texts
    without a repeated window, nearly all, stop after one set look-up a word;
    the others sort their windows, so no text takes quadratic time.
    """
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(cast(text as string), '') as text")
    rows = rows.select(
        "doc_id",
        F.expr(f"transform(filter(split(text, '{_BLANKS}'), w -> w <> ''), w -> xxhash64(w))").alias("w"),
        F.expr(f"cast(char_length(translate(text, {_BLANK_CHARS}, '')) as long)").alias("word_chars"),
        F.expr("cast(char_length(text) - char_length(translate(text, '#*$%&|<>', '')) as long)").alias("n_symbols"),
        F.expr("cast(char_length(text) - char_length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as long)").alias("n_upper"),
        F.expr("cast(char_length(text) - char_length(translate(text, '!?', '')) as long)").alias("n_marks"),
        F.expr(f"filter(split(text, '\\n'), l -> translate(l, {_BLANK_CHARS}, '') <> '')").alias("lines"),
    )
    rows = rows.select(
        "doc_id", F.expr("cast(size(w) as long)").alias("n_words"), "word_chars", "n_symbols", "n_upper", "n_marks",
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr("if(size(w) < 6, cast(array() as array<bigint>), transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])))").alias("windows"),
    )
    rows = rows.withColumn("s", F.expr("if(size(array_distinct(windows)) < size(windows), array_sort(transform(windows, (h, i) -> struct(h as h, i as i))), null)"))
    rows = rows.withColumn("p", F.expr("array_sort(transform(filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i))"))
    repeat = "cast(coalesce(aggregate(transform(p, (x, k) -> if(k = 0, 5, least(5, x - p[greatest(k - 1, 0)]))), 0, (a, x) -> a + x), 0) as long)"
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(repeat).alias("n_repeat_words"), "n_upper", "n_marks")


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: list[dict]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < CONDITIONS:
        p0 = sum(r["poor"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, top = None, 1e-9
        for m in MEASURES:
            values = sorted((r[m], r["poor"]) for r in rows)
            seen = bad = 0
            for k, (v, poor) in enumerate(values):
                if k and v != values[k - 1][0]:
                    # rows from k on, or those before k
                    cut = (v + values[k - 1][0]) / 2
                    for c, p, n in ((Condition(m, True, cut), p0 - bad, n0 - (seen - bad)), (Condition(m, False, cut), bad, seen - bad)):
                        g = _gain(p, n, p0, n0)
                        if g > top:
                            best, top = c, g
                seen += 1
                bad += poor
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if best.holds(r)]
    return rule


def _worth(rule: list[Condition], rows: list[dict]) -> tuple[float, int, int]:
    hit = [r["poor"] for r in rows if all(c.holds(r) for c in rule)]
    p = sum(hit)
    return ((2 * p - len(hit)) / len(hit) if hit else -1.0), p, len(hit)


def learn_list(rows: list[dict]) -> list[list[Condition]]:
    """Rules for poor texts from rows of MEASURES and ``poor`` (0 or 1). Without both classes: none."""
    grow, prune = [r for k, r in enumerate(rows) if k % 3], [r for k, r in enumerate(rows) if not k % 3]
    rules: list[list[Condition]] = []
    while len(rules) < RULES and any(r["poor"] for r in grow):
        rule = _grow(grow)
        if not rule:
            break
        options = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(options, key=lambda o: (_worth(o, prune)[0], -len(o)))
        _, p, hit = _worth(rule, prune)
        if not hit or p < PRECISION * hit:
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional: the first rule that holds rejects; kept otherwise."""
    out = None
    for rule in rules:
        c = F.expr(" and ".join(x.sql() for x in rule))
        out = F.when(c, F.lit(False)) if out is None else out.when(c, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules from the statistics of at most SAMPLE labelled texts, those of lowest id hash.

    Learns only from rows whose crc32(doc_id as text) mod 3 is not 1. What
    reaches the driver is a few numbers for each of these ids; of several texts
    of an id, the one whose numbers sort first counts.
    """
    known = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # rows are sorted out on the driver: a filter here would be pushed below the projections and their expressions repeated
    found = statistics(texts).join(F.broadcast(chosen), "doc_id")
    found = found.select("doc_id", "q", base_failed().alias("failed"), *(F.expr(e).cast("double").alias(m) for m, e in MEASURES.items()))
    one = F.min(F.struct("failed", "q", *MEASURES)).alias("x")
    got = [r for r in found.groupBy("doc_id").agg(one).select("doc_id", "x.*").collect() if not r["failed"]]
    got.sort(key=lambda r: hash((r["doc_id"] * 2654435761) & 0xFFFFFFFF))
    return learn_list([{m: r[m] for m in MEASURES} | {"poor": int(r["q"] == 0)} for r in got])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed and kept for each row of ``docs``.

    kept is false where base_failed, else the list's verdict. Null and empty
    texts have no words and fail the base. Repeated rows and null ids are
    judged as they come; other columns are ignored; an empty table stays
    empty, and without usable labels only the base rejects.
    """
    out = statistics(docs).withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & verdict(learn(docs, labels)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
