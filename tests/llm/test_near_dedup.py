"""Similarity joins against brute force on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import egojoin, minhash
from lexiquarry.llm.components import components
from lexiquarry.llm.scratch import Scratch


def classes(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(r.randint(0, 90), r.randint(0, 90)) for _ in range(50)] + [(7, 7), (None, 3)]
    got = components(Scratch(spark), spark.createDataFrame(edges, "u long, v long"))
    ids = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert {x["id"]: x["component"] for x in got.collect()} == classes(ids, [e for e in edges if set(e) <= ids])
    assert components(Scratch(spark), spark.createDataFrame([], "u long, v long")).count() == 0


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def linked(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    out = []
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                out.append((i, j))
    return sets, out


def corpus():
    r = random.Random(11)
    vocab = [f"w{k}" for k in range(300)]
    rows = [None, "", " \t\n", "one", "ONE", "two words", "Two  Words", "two words"]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(3, 80))]
        rows += [" ".join(base)] * r.randint(1, 3)
        for _ in range(r.randint(0, 6)):
            # copies of copies: chains whose ends need not be similar
            base = [w if r.random() > 0.03 else r.choice(vocab) for w in base]
            rows.append((" ".join(base)).upper() if r.random() < 0.2 else "\n".join(base))
    rows.append("w1 w2 w3 " * 5000)
    r.shuffle(rows)
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_equals_brute_force(spark, n):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, component_id int")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark, df, n, 80).collect()}
    sets, links = linked(rows, n, 80)
    want = classes(sets, links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_minhash_similarity_at_the_threshold_counts(spark):
    # 9 and 10 of 11 words give 8 and 9 shingles; 8 shared of 10 in the union is 80 %
    a, b = [f"a{k}" for k in range(10)], [f"a{k}" for k in range(9)] + ["z"]
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {1: 1, 2: 1}
    c = [f"a{k}" for k in range(8)] + ["y", "z"]
    rows[1] = (2, " ".join(c))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {1: 1, 2: 2}


def test_minhash_texts_that_share_a_doc_id_link_on_their_own(spark):
    r = random.Random(8)
    texts = [[f"{c}{k}" for k in range(60)] for c in "abcdef"]
    near = lambda w: " ".join([*w[:-1], f"z{r.randrange(100)}"])
    rows = [(1, " ".join(w)) for w in texts] + [(10 + k, near(w)) for k, w in enumerate(texts)] + [(30, "alone " * 3)]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(1, 1)] * 6 + [(10 + k, 1) for k in range(6)] + [(30, 30)]


def test_minhash_loose_copies_of_one_text(spark):
    """Near copies of one base that are not all near its leader still become one class where links join them."""
    r = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    sets, links = linked(rows, 2, 80)
    assert got == classes(sets, links)


def test_minhash_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None), (None, None)]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] == 1] == [(1, True)] * 2
    assert minhash.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_loses_no_link_of_a_real_table(spark):
    """Ids divisible by 20 against all rows."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    sets = {i: shingles(t, 2) for i, t in rows}
    links = [(i, j) for i in sets if i % 20 == 0 for j in sets if i != j and 4 * len(sets[i]) <= 5 * len(sets[j]) and 4 * len(sets[j]) <= 5 * len(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert links and all(got[i] == got[j] for i, j in links)


@pytest.mark.parametrize("small", [False, True])
def test_deduplicate_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(minhash, "FOLLOWERS", 2)
        monkeypatch.setattr(minhash, "STRAYS", 2)
        monkeypatch.setattr(minhash, "OTHERS", 3)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 40)
        monkeypatch.setattr(minhash, "FILTER_BITS", 1 << 7)
    r = random.Random(5)
    texts = [(d, t) for d, t in corpus() if not t or len(t) < 5000]
    # ids that repeat with other texts, missing ids, and rows equal in all columns
    rows = [(None if r.random() < 0.15 else d // 3 % 40, t, k % 3) for k, (d, t) in enumerate(texts)]
    rows += [x for x in rows if r.random() < 0.2] + [(9, "only ever twice in here", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = minhash.deduplicate(spark, df, 2, 80)
    assert got.columns == df.columns
    got = Counter(map(tuple, got.collect()))
    cls = classes(range(len(rows)), linked([(i, t) for i, (_, t, _) in enumerate(rows)], 2, 80)[1])
    assert got[(9, "only ever twice in here", 1)] == 1
    of, kept = defaultdict(list), defaultdict(list)
    for i, row in enumerate(rows):
        of[cls[i]].append(row)
    words_of = {c for c in of if words(of[c][0][1])}
    where = {row: c for c, rs in of.items() for row in rs}
    for row, n in got.items():
        if where[row] in words_of:
            kept[where[row]] += [row] * n
        else:
            assert n == rows.count(row)
    assert {c: len(k) for c, k in kept.items()} == {c: 1 for c in words_of}
    for c, [row] in kept.items():
        ids = [x[0] for x in of[c] if x[0] is not None]
        assert row[0] == (min(ids) if ids else None)
    assert minhash.deduplicate(spark, df.where("false")).count() == 0


def vectors():
    r = np.random.default_rng(8)
    out = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0]]
    for _ in range(20):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 6)):
            out.append((base * r.uniform(0.1, 50) + r.normal(size=8) * 0.25).tolist())
            base = base + r.normal(size=8) * 0.2
    out += [[1e-30] + [0.0] * 7, [1e30] + [0.0] * 7, [0.9, 0.19**0.5] + [0.0] * 6] + [[3.0] * 8] * 4
    return [(2 * k, v) for k, v in enumerate(out)]


def vector_links(rows, limit):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in ok.items()}
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    return [(i, j) for i in unit for j in unit if i < j and len(unit[i]) == len(unit[j]) and cos(unit[i], unit[j]) >= limit]


@pytest.mark.parametrize(("interval", "leaf"), [(8192, 512), (7, 2)])
def test_vectors_equal_brute_force(spark, monkeypatch, interval, leaf):
    monkeypatch.setattr(egojoin, "TILE", 3)
    monkeypatch.setattr(egojoin, "INTERVAL", interval)
    monkeypatch.setattr(egojoin, "LEAF", leaf)
    monkeypatch.setattr(egojoin, "FAN", 2)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "l", 0) for i, v in rows], "vec_id long, embedding array<double>, label string, x int")
    got = {r["vec_id"]: r for r in egojoin.near_duplicates(spark, df, 0.9).collect()}
    links = vector_links(rows, 0.9)
    want = classes([i for i, _ in rows], links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in e for e in links) for i in want}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_vectors_of_one_id_and_planted_links(spark, monkeypatch):
    """Links in a table without any, hot copies, repeated vec_ids with equal and other vectors; single precision."""
    monkeypatch.setattr(egojoin, "INTERVAL", 60)
    monkeypatch.setattr(egojoin, "LEAF", 16)
    monkeypatch.setattr(egojoin, "TILE", 2)
    r = np.random.default_rng(3)
    base = [np.array(x["embedding"], float) for x in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(250).collect()]
    rows = list(enumerate(base)) + [(300 + k, base[k] + r.normal(size=len(base[k])) * 0.03) for k in range(0, 60, 3)] + [(400 + k, base[7]) for k in range(50)]
    rows += [(5, base[20]), (5, base[5]), (8, base[8]), (9, base[11] * 2)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in rows]
    got = egojoin.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9).collect()
    unit = np.array([v for _, v in rows], float)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.9
    ids = [i for i, _ in rows]
    links = Counter()
    for k, n in enumerate(near.sum(axis=1) - 1):
        links[ids[k]] += int(n)
    want = classes(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    assert len(got) == len(rows) and sum(links.values()) > 1000
    assert all((x["n_links"], x["component_id"], x["kept"]) == (links[x["vec_id"]], want[x["vec_id"]], want[x["vec_id"]] == x["vec_id"]) for x in got)


def test_vectors_without_any_valid(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")
    got = egojoin.near_duplicates(spark, df).orderBy(F.desc_nulls_last("vec_id")).collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got] == [(1, 0, 1, True), (None, 0, None, True)]
    assert egojoin.near_duplicates(spark, df.where("vec_id = 5")).count() == 0
