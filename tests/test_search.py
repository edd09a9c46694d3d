"""Search operators: fixed expectations on a mini corpus, and brute force on random ones."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import analysis
from lexiquarry.operators import bloom, index as ix, search
from lexiquarry.operators.search import BM25
from lexiquarry.plans import query as qp
from lexiquarry.plans.engine import TextIndex

MINI = [
    (1, "a", "fulltext search is the main topic here"),
    (2, "b", "this document mentions fulltext once"),
    (3, "c", ""),
    (4, "d", "search the search index is the fulltext search"),
]


@pytest.fixture(scope="module")
def mini(spark):
    return TextIndex(ix.build(spark.createDataFrame(MINI, "doc_id long, title string, content string")).persist())


def hits(df):
    return [(r["doc_id"], round(r["raw_score"], 6), r["score"]) for r in df.collect()]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("fulltext", [(2, 0.356675, 356), (1, 0.306518, 306), (4, 0.286381, 286)]),
        ("search", [(4, 0.965142, 965), (1, 0.595673, 595)]),
        ("the", [(4, 0.815467, 815), (1, 0.595673, 595)]),
        ("fulltext search", [(4, 1.501828, 1501), (1, 1.082629, 1082)]),
        ("the search", [(4, 2.136731, 2136)]),
        ("mentions || fulltext && search", [(4, 1.251523, 1251), (1, 0.902191, 902)]),
        ("mentions && fulltext || search", [(2, 1.560648, 1560), (4, 1.251523, 1251), (1, 0.902191, 902)]),
        ("nothing", []),
    ],
)
def test_bm25_on_the_mini_corpus(mini, query, want):
    assert hits(mini.full_text(query)) == want


def test_operations_by_name(mini):
    assert mini.run("EXACT", "Search").first()["found"] and not mini.run("exact", "sear").first()["found"]
    assert sorted(r["doc_id"] for r in mini.run("prefixDocs", "s").collect()) == [1, 4]
    assert [r["term"] for r in mini.run("autocomplete", "men").collect()] == ["mentions"]
    assert [r["term"] for r in mini.run("autocomplete", "").collect()] == []
    assert mini.run("bloom", "fulltext").first()["found"]
    with pytest.raises(ValueError):
        mini.run("other", "x")
    with pytest.raises(ValueError):
        mini.search("  ")


def test_search_adds_titles_and_snippets(mini):
    got = mini.search("fulltext", limit=2).collect()
    assert [(r["doc_id"], r["title"]) for r in got] == [(2, "b"), (1, "a")] and "<mark>fulltext</mark>" in got[0]["snippet"]
    assert {r["doc_id"] for r in mini.search("ful*").collect()} == {1, 2, 4}
    assert "<mark>topic</mark>" in mini.document("a", "topic").first()["content"] and mini.document("z").count() == 0
    assert mini.title_of(4).first()["title"] == "d" and mini.content_of(9).count() == 0


def test_parameters(mini):
    with pytest.raises(ValueError):
        BM25(k1=-1)
    with pytest.raises(ValueError):
        BM25(b=1.5)
    with pytest.raises(ValueError):
        BM25(scoring="no")
    assert [r["score"] for r in mini.with_params(scoring="tf").full_text("search").collect()] == [3000, 1000]
    assert {r["score"] for r in mini.with_params(scoring="zero").full_text("search").collect()} == {0}


def test_maintenance(spark, mini):
    fields = "doc_id long, title string, content string"
    new = spark.createDataFrame([(9, "n", "fulltext added"), (2, "b", "replaced words")], fields)
    changed = mini.add(new)
    assert [r["doc_id"] for r in changed.full_text("fulltext").orderBy("doc_id").collect()] == [1, 4, 9]
    assert [r["doc_id"] for r in changed.full_text("replaced").collect()] == [2]
    back = changed.remove(new.where("doc_id = 9")).add(spark.createDataFrame(MINI[1:2], fields))
    assert hits(back.full_text("fulltext")) == hits(mini.full_text("fulltext"))
    assert hits(mini.rebuild().full_text("search")) == hits(mini.full_text("search"))
    assert mini.clear().full_text("search").count() == 0
    kept = ix.upsert_terms(mini.index.postings, spark.createDataFrame([(1, 0, "only")], "doc_id long, position int, term string"))
    assert [r["term"] for r in kept.where("doc_id = 1").collect()] == ["only"] and kept.where("doc_id = 4").count() == 5


def _shuffles(frame):
    frame.collect()  # of what ran, not of what was planned
    return [x.strip(" +-:*()0123456789") for x in frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n") if "Exchange" in x]


def test_postings_need_no_shuffle(spark):
    texts = ["b a b", "", None, "a", "é É é x1 " * 50]
    made = ix.build(spark.createDataFrame([(k, "t", t) for k, t in enumerate(texts)], "doc_id long, title string, content string"))
    assert not _shuffles(made.postings) and not _shuffles(search.prefix_rows(made, "b"))
    rows = sorted((r["term"], r["doc_id"], r["tf"], tuple(r["positions"]), r["doc_len"]) for r in made.postings.collect())
    assert rows == [("a", 0, 1, (1,), 3), ("a", 3, 1, (0,), 1), ("b", 0, 2, (0, 2), 3), ("x1", 4, 50, tuple(range(3, 200, 4)), 200), ("é", 4, 150, tuple(k for k in range(200) if k % 4 < 3), 200)]
    by_tokens = ix.build_postings(analysis.tokenize(made.documents, "content"))
    assert sorted((r["term"], r["doc_id"], r["tf"], tuple(r["positions"]), r["doc_len"]) for r in by_tokens.collect()) == rows
    assert [(r["doc_id"], r["doc_len"]) for r in made.doc_stats.orderBy("doc_id").collect()] == [(0, 3), (1, 0), (2, 0), (3, 1), (4, 200)]


def test_a_persisted_index_counts_the_words_asked_for_alone(spark):
    kept = ix.build(spark.range(300).selectExpr("id AS doc_id", "'t' AS title", "concat('was w', id % 7, ' v', id) AS content")).persist()
    for frame in (kept.df_of(["was"]), kept.vocab().where(F.col("term").startswith("w"))):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.find("Aggregate") < plan.find("Filter") < plan.find("InMemoryRelation")
    assert [(r["term"], r["df"]) for r in search.autocomplete(kept, "w", 3).collect()] == [("was", 300), ("w0", 43), ("w1", 43)]
    assert search.exact(kept, "was").count() == 300
    kept.unpersist()


def test_rebuilding_leaves_positions_in_their_rows(noise):
    _, index = noise
    again = ix.rebuild(index)
    assert "explode(positions" not in again.postings._jdf.queryExecution().optimizedPlan().toString()
    plan = again.postings.where("term = 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Join") < plan.find("= a)")  # the word is looked for before the join
    rows = lambda i: sorted(map(repr, i.postings.collect()))
    assert rows(again) == rows(index) and sorted(again.doc_stats.collect()) == sorted(index.doc_stats.collect())


def test_repeated_ids(spark, mini):
    fields = "doc_id long, title string, content string"
    twice = spark.createDataFrame([(9, "n", "fulltext one"), (9, "n", "fulltext two"), (2, "b", "x"), (2, "a", "y"), (None, "z", "fulltext")], fields)
    changed = mini.add(twice)
    assert [(r["doc_id"], r["doc_len"]) for r in changed.index.doc_stats.orderBy("doc_id").collect()] == [(1, 7), (2, 1), (3, 0), (4, 8), (9, 2)]
    assert [r["doc_id"] for r in changed.full_text("two").collect()] == [9] and changed.full_text("one").count() == 0
    with pytest.raises(Exception, match="several documents have the doc_id"):
        ix.build(twice).doc_stats.collect()


def test_removals_and_pages(spark, mini):
    ids = spark.createDataFrame([(1,), (1,), (999,)], "doc_id long")
    assert {(r["doc_id"], r["existed"]) for r in ix.existed(mini.index, ids).collect()} == {(1, True), (999, False)}
    bare = ix.remove_terms(mini.index, ids)
    assert bare.documents.count() == 4 and search.exact_docs(bare, "topic").count() == 0 and bare.doc_stats.where("doc_id = 1").first()["doc_len"] == 0
    every = [r["doc_id"] for r in mini.search("fulltext").collect()]
    assert [r["doc_id"] for r in mini.search("fulltext", 1, 1).collect()] == every[1:2] and [r["doc_id"] for r in mini.search("fulltext", offset=2).collect()] == every[2:]
    got = mini.response("fulltext", 2)
    assert got["totalCount"] == 3 and got["operation"] == "Exact" and got["parameters"] == {"k1": 1.2, "b": 0.75}
    assert [(r["id"], r["score"]) for r in got["results"].collect()] == [("2", 35.6), ("1", 30.6)]
    assert mini.last_word_exists("no such topic").first()["found"] and not mini.last_word_exists("topic nosuch").first()["found"]


def test_positions_forms(spark, mini):
    p = mini.index.postings
    assert ix.from_positions_json(ix.positions_json(p)).count() == p.selectExpr("sum(tf)").first()[0]
    delta = p.select("positions", F.expr(ix.delta_encode("positions")).alias("d")).select("positions", F.expr(ix.delta_decode("d")).alias("back"))
    assert delta.where("positions <> back").count() == 0


def _score(corpus, term, doc, k1=1.2, b=0.75):
    n, tf = sum(term in d for d in corpus), corpus[doc].count(term)
    if not tf:
        return None
    norm = tf / (1 - b + b * len(corpus[doc]) / (sum(map(len, corpus)) / len(corpus)))
    return math.log((len(corpus) - n + 0.5) / (n + 0.5) + 1) * norm * (k1 + 1) / (norm + k1)


@pytest.fixture(scope="module")
def noise(spark):
    r = random.Random(5)
    corpus = [[r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(40)]
    df = spark.createDataFrame([(k, f"t{k}", " ".join(d)) for k, d in enumerate(corpus)], "doc_id long, title string, content string")
    return corpus, ix.build(df).persist()


def test_phrases_against_brute_force(noise):
    corpus, index = noise
    for q in ("a b", "a a", "a b a", "d c b a", "a z"):
        words = q.split()
        found = {k for k, d in enumerate(corpus) if any(d[i : i + len(words)] == words for i in range(len(d)))}
        got = search.phrase(index, q).collect()
        assert {r["doc_id"] for r in got} == found, q
        for r in got:
            assert r["raw_score"] == pytest.approx(1.2 * sum(_score(corpus, w, r["doc_id"]) for w in words))
        assert [(r["doc_id"], r["count"]) for r in search.phrase_count(index, q).collect()] == [(k, len(words) - 1) for k in sorted(found)]


def test_booleans_against_brute_force(noise):
    corpus, index = noise
    r = random.Random(6)
    for _ in range(12):
        terms = [r.choice("abcdz") for _ in range(r.randint(1, 5))]
        ops = [r.choice(("&&", "||")) for _ in terms[1:]]
        q = " ".join([terms[0], *(f"{o} {t}" for o, t in zip(ops, terms[1:], strict=True))])
        match = {k for k, d in enumerate(corpus) if terms[0] in d}
        for o, t in zip(ops, terms[1:], strict=True):
            own = {k for k, d in enumerate(corpus) if t in d}
            match = match & own if o == "&&" else match | own
        got = {x["doc_id"]: x["raw_score"] for x in search.boolean(index, q).collect()}
        assert set(got) == match == {x["doc_id"] for x in search.boolean_sets(index, q).collect()}, q
        for k, s in got.items():
            assert s == pytest.approx(sum(_score(corpus, t, k) or 0 for t in terms))


def test_dangling_operators_are_ignored(noise):
    _, index = noise
    want = {r["doc_id"] for r in search.boolean(index, "a && b").collect()}
    for q in ("&& a && b", "a && b ||", "a || && b"):
        assert {r["doc_id"] for r in search.boolean(index, q).collect()} == want
    assert {r["doc_id"] for r in search.boolean_sets(index, "&& a && b ||").collect()} == want
    assert search.boolean(index, "&&").count() == 0


def _completed(vocab, q):
    """The search for ever shorter prefixes."""
    if not q:
        return []
    hits = [w for w in vocab if w.startswith(q)]
    n = len(q)
    while not hits and n > 2:
        n -= 1
        lcp = lambda w: next((i for i in range(min(len(w), len(q))) if w[i] != q[i]), min(len(w), len(q)))
        hits = [w for w in vocab if w.startswith(q[:n]) and lcp(w) >= 0.6 * len(q)]
    return sorted(hits, key=lambda w: (-vocab[w], len(w), w))


def test_autocompletion_against_the_loop(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(60)]
    docs = [[r.choice(words) for _ in range(10)] for _ in range(20)]
    index = ix.build(spark.createDataFrame([(k, "t", " ".join(d)) for k, d in enumerate(docs)], "doc_id long, title string, content string")).persist()
    vocab = Counter(w for d in docs for w in set(d))
    for _ in range(25):
        q = "".join(r.choice("abc") for _ in range(r.randint(1, 8)))
        assert [x["term"] for x in search.autocomplete(index, q, None).orderBy("rank").collect()] == _completed(vocab, q), q


def _ran(frame):
    """The rows, and the final plan of what ran for them."""
    rows = frame.collect()
    return rows, frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_autocompletion_counts_words_as_documents_are_read(spark, tmp_path):
    r = random.Random(8)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(60)]
    docs = [" ".join(r.choice(words) for _ in range(10)) for _ in range(20)] + ["", None]
    spark.createDataFrame([(k, "t", d) for k, d in enumerate(docs)], "doc_id long, title string, content string").write.parquet(f"{tmp_path}/docs")
    made = ix.build(spark.read.parquet(f"{tmp_path}/docs"))
    vocab = Counter(w for d in docs if d for w in set(d.split()))
    assert {x["term"]: x["df"] for x in made.dfs().collect()} == vocab
    made.save(f"{tmp_path}/index")
    stored, queries = ix.Index.load(spark, f"{tmp_path}/index"), ["a", "ab", "abc", "abzz", "aabbz", "ccczz", "bacabzzz", "zz"]
    for q in queries:
        rows, plan = _ran(search.autocomplete(made, q, None))
        assert [x["term"] for x in rows] == [x["term"] for x in search.autocomplete(stored, q, None).collect()] == _completed(vocab, q), q
        assert [x["df"] for x in rows] == [vocab[x["term"]] for x in rows]
        assert "position" not in plan and plan.count("FileScan") <= 1, plan


@pytest.mark.parametrize("name", ["autocomplete", "autocomplete_fallback"])
def test_autocompletion_keeps_no_postings(spark, name):
    from lexiquarry.plans import registry

    _, plan = _ran(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "InMemoryTableScan" not in plan and "position" not in plan


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Foo-Bar", "foo"), ("Foo-Bar BAZ", "foo baz"), ("Cat&&Dog || Big Bird", "cat && dog || big"), ("&& cat", "cat &&"), ("a && && b", "a &&  && b"), ("word#", "word"), ("pre*", "pre*"), ("&", "&"), ("  ", "  ")],
)
def test_normalisation(raw, want):
    got = qp.normalize(raw)
    # two operands and three operators, or the like: blanks between operators do not matter to the parser
    assert search.parse_boolean(got) == search.parse_boolean(want) if "&&" in raw else got == want


def test_query_words_are_index_words(spark):
    from lexiquarry.functions import analysis

    for raw in ("x²", "½cup", "\U0001d400bc", "été-2", "a_b", "٣x"):
        index = [r["term"] for r in analysis.tokenize(spark.createDataFrame([(1, raw)], "doc_id long, text string")).orderBy("position").collect()]
        assert qp.first_word(raw) == index[0], raw
    assert qp.first_word("ⅷ") == "ⅷ"


def test_routing():
    assert [qp.route(q).kind for q in ("x", "x y", "x && y", "x*", "x && y*")] == ["exact", "phrase", "boolean", "prefix", "prefix"]
    assert [qp.label(q) for q in ("x", "x y", "x || y", "x*", "x#")] == ["Exact", "Phrase", "Boolean", "Prefix", "Ranked"]


@pytest.mark.parametrize(
    ("n", "p", "bits", "hashes"),
    [(100_000, 0.01, 958506, 7), (1_000_000, 0.01, 9585059, 7), (2_000_000, 0.03, 14596882, 5), (1000, 0.01, 9586, 7)],
)
def test_bloom_shape(n, p, bits, hashes):
    assert bloom.shape(n, p) == (bits, hashes)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    terms = spark.range(2000).selectExpr("concat('w', id) as term")
    made = bloom.build(terms, 2000, 0.01)
    assert all(f"w{k}" in made for k in range(2000)) and "" not in made and None not in made
    assert sum(f"x{k}" in made for k in range(5000)) < 150
    asked = spark.createDataFrame([("w1",), ("",), (None,)], "term string").select(bloom.might_contain(made, F.col("term")).alias("m")).collect()
    assert [r["m"] for r in asked] == [True, False, False]
    absent = spark.range(5000).select(bloom.might_contain(made, F.expr("concat('x', id)")).alias("m"))
    assert absent.where("m").count() == sum(f"x{k}" in made for k in range(5000))
    plan = absent._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and terms.select(bloom.might_contain(made, F.col("term")).alias("m")).where("not m").count() == 0
    empty = bloom.build(terms.where("false"), 10, 0.1)
    assert "w1" not in empty
    made.clear()
    assert "w1" not in made and made.size_mb > 0
    made.add("w1"), made.add(None)
    assert "w1" in made
    known = bloom.contains(spark.createDataFrame([("w1",), ("zz",)], "term string"), terms).collect()
    assert {(r["term"], r["found"]) for r in known} == {("w1", True), ("zz", False)}


def test_bloom_has_room_for_every_term(spark, monkeypatch):
    terms = spark.range(400_000).selectExpr("concat('w', id) as term")
    asked = spark.range(50_000).selectExpr("concat('x', id) as term")
    found = lambda made, of: of.where(bloom.might_contain(made, F.col("term"))).count()
    whole = bloom.build(terms)
    assert found(whole, terms) == 400_000 and found(whole, asked) < 1000
    monkeypatch.setattr(bloom, "PART", 150_000)
    parts = bloom.build(terms, 400_000)
    assert len(parts.jvm) == 3 and found(parts, terms) == 400_000
    held = [r["term"] for r in asked.where(bloom.might_contain(parts, F.col("term"))).collect()]
    assert len(held) < 1000 and all(t in parts for t in held) and "w399999" in parts
    assert len(bloom.might_contain(parts, F.col("term"))._jc.toString()) < 10_000  # no bits in the plan


def test_bloom_absent_with_more_terms_than_a_million(spark, tmp_path):
    from lexiquarry.plans import registry

    text = "array_join(transform(sequence(0, 9999), k -> concat('w', id * 10000 + k)), ' ')"
    spark.range(160).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    assert tuple(registry.QUERIES["bloom_absent"](spark, str(tmp_path)).first()) == (1_600_000, True)
    registry.built(spark, str(tmp_path)).unpersist()
