"""MinHash near-dedup by a multi-index Hamming join.

A document's shingle set gets a signature of ``BLOCKS * WIDTH`` symbols, each a
MinHash value cut to 16 bits. The signature is split into ``BLOCKS`` blocks.
If two signatures differ in at most ``2 * BLOCKS - 1`` symbols, some block has
at most one error (pigeonhole), so a block matches with at most one symbol left
out; each block is therefore indexed under its ``WIDTH`` leave-one-out keys and
every pair within that distance meets under a key. Pairs farther apart can meet
as well, and a pair at similarity 0.8 meets with probability above 0.9997
(0.99998 at 0.85), since all eight blocks would need two errors or more.

Pairs that meet are dropped if their set sizes alone rule out a link, or if
their signatures differ in more than ``ERRORS`` symbols, which happens to a
pair at similarity 0.8 with probability below 0.00001. Only for what is left are
texts fetched, and links are confirmed on the full 64-bit shingle sets. A
bucket of documents is never expanded into its pairs:

1. equal sets collapse to one representative;
2. every member of a bucket is compared with the bucket's leader, the member
   that meets others most often, and the links give components;
3. only buckets whose other members still lie in different components are
   searched further: members outside a bucket's largest component are compared
   by signature, in blocks, with all others, and each block returns a spanning
   forest of the pairs within ``ERRORS``. The trees form communities, whose
   members are compared in blocks on their full sets.

The components of these links are those of all links between documents that
met under a key. No step has a limit on bucket size, partners or candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiquarry.llm import wordhash as W
from lexiquarry.llm.components import components
from lexiquarry.llm.scratch import Scratch, small_batches

BLOCKS, WIDTH = 8, 6
ERRORS = 23
STRAYS, OTHERS = 256, 1024
#: Shingles of the strays and of the others in a block whose sets are compared, about: a block of long texts has fewer of them.
BLOCK_SHINGLES = 1 << 19
#: Followers that meet one copy of their leader.
FOLLOWERS = 2048
#: Bits of the filter in front of a fetch, in 64-bit words; 131072 rows at most, whatever the data.
FILTER_BITS = 1 << 23
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(77))
_HASH = _rng.integers(1, 1 << 63, BLOCKS * WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_SLOT = _rng.integers(1, 1 << 63, (BLOCKS, WIDTH), dtype=np.uint64) * _U(2) + _U(1)
_SALT = _rng.integers(1, 1 << 63, (BLOCKS, WIDTH), dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after the other, and their offsets."""
    starts, ends, first = W.spans(raw, offsets)
    value, at = W.grams(W.hashes(raw, starts, ends), first, n)
    parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(sizes)):
        x = np.sort(value[at[i] : at[i + 1]])
        if len(x) > 1:
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        parts.append(x)
        sizes[i] = len(x)
    return (np.concatenate(parts) if parts else value[:0]), np.concatenate(([0], np.cumsum(sizes)))


def _each_set(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    raw, offsets = W.texts(column)
    for a, b in W.chunks(offsets):
        value, at = shingle_sets(W.LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], n)
        for i in range(b - a):
            yield value[at[i] : at[i + 1]]


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x)))
    return total[at[1:]] - total[at[:-1]]


def _signed(n: int):
    """The columns after the text are passed on."""

    @W.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = W.texts(batch.column(0))
            rest = batch.select(range(1, batch.num_columns))
            for a, b in W.chunks(offsets):
                value, at = shingle_sets(W.LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], n)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                sig = np.zeros((b - a, len(_HASH)), np.uint16)
                if len(full):
                    for k, h in enumerate(_HASH):
                        sig[full, k] = W.mix(np.minimum.reduceat(value * h, at[full])).astype(np.uint16)
                flat = sig.view(np.uint8).reshape(b - a, -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *rest.slice(a, b - a).columns,
                        pa.array(sizes),
                        pa.array(_sums(W.mix(value ^ _U(0x5851F42D4C957F2D)), at).view(np.int64)),
                        pa.array(_sums(W.mix(value ^ _U(0x14057B7EF767814F)), at).view(np.int64)),
                        pa.array([x.tobytes() for x in flat], pa.binary()),
                    ],
                    [*rest.schema.names, "n_shingles", "d1", "d2", "sig"],
                )

    return run


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BLOCKS * WIDTH)


@W.released
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    per = BLOCKS * WIDTH
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            sig = _symbols(part.column(1)).reshape(-1, BLOCKS, WIDTH).astype(np.uint64)
            terms = W.mix(sig + _SALT) * _SLOT
            keys = W.mix(terms.sum(axis=2, dtype=np.uint64)[:, :, None] - terms + _SALT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), per))], ["key", "rep"]
            )


@W.released
def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most ``ERRORS`` symbols."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            far = (_symbols(part.column(2)) != _symbols(part.column(3))).sum(axis=1)
            yield part.select([0, 1]).filter(pa.array(far <= ERRORS))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The link test, on sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(both) - same)


def _starred(n: int, percent: int):
    """Rows ordered by (leader, chunk, side): a leader (side 0) and its followers -> links. One leader's set is held."""

    @W.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, center = None, None
        for batch in batches:
            leader, chunk, side = (batch.column(c).to_numpy().tolist() for c in range(3))
            keep = []
            for i, own in enumerate(_each_set(batch.column(4), n)):
                if side[i] == 0:
                    star, center = (leader[i], chunk[i]), own.copy()
                elif star == (leader[i], chunk[i]) and alike(own, center, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(keep, pa.int64())), batch.column(0).take(pa.array(keep, pa.int64()))], ["u", "v"])

    return run


class _Forest:
    def __init__(self, ids):
        self.parent = {int(c): int(c) for c in ids}

    def root(self, c: int) -> int:
        p = self.parent
        while p[c] != c:
            p[c] = c = p[p[c]]
        return c

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _edges(out: list[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())]


def _plausible(percent: int):
    """Rows ordered by (key, i, j), the strays of a block (side 0) and what they are compared with: a forest of the pairs within ``ERRORS``."""

    def block(side, rep, comp, size, sig) -> list[tuple[int, int]]:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[tuple[int, int]] = []
        if not len(left) or not len(right):
            return out
        trees = _Forest(rep)
        for a in range(0, len(left), 32):
            x = left[a : a + 32]
            ok = comp[x][:, None] != comp[right][None]
            low, high = np.minimum(size[x][:, None], size[right][None]), np.maximum(size[x][:, None], size[right][None])
            ok &= 100 * low >= percent * high
            ok &= (sig[x][:, None, :] != sig[right][None]).sum(axis=2) <= ERRORS
            for i, j in zip(*np.nonzero(ok), strict=True):
                u, v = int(rep[x[i]]), int(rep[right[j]])
                if trees.join(u, v):
                    out.append((u, v))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def cut(last: bool) -> Iterator[tuple[int, int]]:
            """Whole blocks of what is held; the last one stays unless nothing follows."""
            nonlocal held
            new = np.any(held[0][1:] != held[0][:-1], axis=1)
            at = [0, *(np.flatnonzero(new) + 1).tolist(), len(held[0])]
            for a, b in zip(at[:-1] if last else at[:-2], at[1:], strict=last):
                yield from block(*(x[a:b] for x in held[1:]))
            held = None if last else [x[at[-2] :] for x in held]

        for batch in batches:
            if batch.num_rows:
                name = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
                part = [name, *(batch.column(c).to_numpy() for c in range(3, 7)), _symbols(batch.column(7))]
                held = part if held is None else [np.concatenate(z) for z in zip(held, part, strict=True)]
                yield pa.RecordBatch.from_arrays(_edges(list(cut(False))), ["u", "v"])
        if held is not None:
            yield pa.RecordBatch.from_arrays(_edges(list(cut(True))), ["u", "v"])

    return run


def _block_links(n: int, percent: int):
    """Links between a block of strays (side 0) and a block of others (side 1) that join components."""

    def run(table: pa.Table) -> pa.Table:
        rep, comp, side = (table.column(c).to_numpy() for c in ("rep", "comp", "side"))
        sets = [x.copy() for x in _each_set(table.column("text").combine_chunks(), n)]
        sizes = np.array([len(x) for x in sets])
        words, code = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate(([0], np.cumsum(sizes)))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            trees = _Forest(comp)
            flat = np.concatenate([code[at[j] : at[j + 1]] for j in right])
            begin = np.concatenate(([0], np.cumsum(sizes[right])))[:-1]
            flag = np.zeros(len(words), np.int32)
            for i in left:
                own = code[at[i] : at[i + 1]]
                flag[own] = 1
                same = np.add.reduceat(flag[flat], begin)
                flag[own] = 0
                hit = np.flatnonzero(100 * same >= percent * (sizes[right] + sizes[i] - same))
                out += [(int(rep[i]), int(rep[j])) for j in right[hit] if trees.join(int(comp[i]), int(comp[j]))]
        return pa.table(dict(zip(("u", "v"), _edges(out), strict=True)))

    return run


def _blocked(people: DataFrame, group: str, carry: list[str], size: str = "0L") -> DataFrame:
    """Comparison tasks (group, i, j) over rows (group, rep, comp, *carry).

    A group's strays lie outside its most frequent component. Block i of them
    (side 0) meets block j of the strays (j >= i) or of the others (side 1).
    ``size``: what a row counts towards ``BLOCK_SHINGLES``.
    """
    per = people.groupBy(group, "comp").agg(F.count("*").alias("n"), F.sum(F.expr(size)).alias("s"))
    main = per.groupBy(group).agg(F.max(F.struct("n", "comp", "s")).alias("m"), F.sum("n").alias("all"), F.sum("s").alias("sum"))
    blocks = lambda n, most, s: F.ceil(F.greatest(n / most, s / BLOCK_SHINGLES)).cast("int")
    others = blocks(F.col("m.n"), OTHERS, F.col("m.s"))
    strays = blocks(F.col("all") - F.col("m.n"), STRAYS, F.col("sum") - F.col("m.s"))
    main = main.select(group, F.col("m.comp").alias("main"), others.alias("nm"), strays.alias("ns"))
    people = people.join(main, group).withColumn("stray", F.expr("comp <> main"))
    people = people.withColumn("at", F.expr("cast(pmod(xxhash64(rep), if(stray, ns, nm)) as int)"))
    own = [group, "rep", "comp", *carry]
    first = people.where("stray").select(*own, F.lit(0).alias("side"), F.col("at").alias("i"), F.explode(F.expr("sequence(at, ns + nm - 1)")).alias("j"))
    second = people.select(*own, F.lit(1).alias("side"), F.explode(F.expr("sequence(0, if(stray, at, ns - 1))")).alias("i"), F.expr("if(stray, at, ns + at)").alias("j"))
    return first.unionByName(second)


def _fetched(scratch: Scratch, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and text of ``wanted(rep, k)``.

    A filter of fixed size keeps most other texts from the shuffle; where it
    is full, more of them pass and the join alone decides.
    """
    word, bit = F.expr(f"pmod(k, {FILTER_BITS}L) div 64").alias("word"), F.expr("shiftleft(1L, cast(pmod(k, 64L) as int))").alias("bit")
    words = scratch.keep(wanted.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")))
    maybe = docs.select("k", "text", word, bit).join(F.broadcast(words), "word").where("bits & bit <> 0")
    texts = maybe.groupBy("k").agg(F.first("text").alias("text"))  # repeated rows meet here, partly before the shuffle
    out = scratch.keep(texts.join(wanted, "k").select("rep", "text"))
    scratch.drop(words)
    return out


def _classes(scratch: Scratch, docs: DataFrame, signed: DataFrame, shingle: int, percent: int) -> DataFrame:
    """d1, d2, n_shingles and rep_class of each set in ``signed``, which has doc_id, k, n_shingles, d1, d2, sig.

    ``docs``: text and k, which tells texts apart; ``rep_class`` is an id of the set's class.
    """
    # a representative is a set, not a doc_id, which several sets may share
    reps = scratch.keep(signed.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles", "sig").agg(F.min("k").alias("k")).withColumn("rep", F.xxhash64("d1", "d2", "n_shingles")))
    keys = reps.select("rep", "sig").mapInArrow(_keyed, "key long, rep long")
    met = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = scratch.keep(keys.join(met, "key"))
    weight = members.groupBy("rep").agg(F.sum(F.col("c") - 1).alias("w"))
    leaders = members.join(weight, "rep").groupBy("key").agg((-F.max(F.struct("w", (-F.col("rep")).alias("r")))["r"]).alias("leader"))
    led = scratch.keep(members.join(leaders, "key").where("rep <> leader").select("key", "rep", "leader"))
    scratch.drop(members)

    # members and leaders that their sizes and signatures do not tell apart
    narrow = reps.select("rep", "n_shingles", "sig")
    other = narrow.select(F.col("rep").alias("leader"), F.col("n_shingles").alias("m"), F.col("sig").alias("s"))
    pairs = led.select("rep", "leader").distinct().join(narrow, "rep").join(other, "leader")
    pairs = pairs.where(f"100 * least(n_shingles, m) >= {percent} * greatest(n_shingles, m)").select("rep", "leader", "sig", "s")
    pairs = scratch.keep(pairs.mapInArrow(_close, "rep long, leader long"))

    chunks = pairs.groupBy("leader").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("chunks"))
    stars = pairs.join(chunks, "leader").select("rep", "leader", F.expr("cast(pmod(xxhash64(rep), chunks) as int)").alias("chunk"), F.lit(1).alias("side"))
    stars = stars.unionByName(chunks.select(F.col("leader").alias("rep"), "leader", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.lit(0).alias("side")))
    wanted = reps.join(pairs.select("rep").union(pairs.select("leader")).distinct(), "rep", "left_semi").select("rep", "k")
    texts = _fetched(scratch, docs, wanted)
    stars = stars.join(texts, "rep").select("leader", "chunk", "side", "rep", "text").repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "side")
    links = scratch.keep(small_batches(stars).mapInArrow(_starred(shingle, percent), "u long, v long"))
    scratch.drop(texts, pairs)
    comps = components(scratch, links)

    # buckets whose members besides the leader are not all in one component; of those with equal members, one
    named = led.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    open_keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who")).where("lo <> hi")
    open_keys = open_keys.groupBy("n", "who").agg(F.min("key").alias("key"))
    loose = scratch.keep(named.join(open_keys, "key", "left_semi"))
    scratch.drop(led)
    if loose.take(1):
        people = loose.join(narrow, "rep").select("key", "rep", "comp", "n_shingles", "sig")
        tasks = _blocked(people, "key", ["n_shingles", "sig"]).select("key", "i", "j", "side", "rep", "comp", "n_shingles", "sig")
        tasks = tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        forest = scratch.keep(tasks.mapInArrow(_plausible(percent), "u long, v long"))
        groups = components(scratch, forest).withColumnRenamed("id", "rep").withColumnRenamed("component", "grp")
        people = scratch.keep(loose.select("rep", "comp").distinct().join(groups, "rep").join(reps.select("rep", "n_shingles"), "rep"))
        texts = _fetched(scratch, docs, reps.join(people, "rep", "left_semi").select("rep", "k"))
        tasks = _blocked(people, "grp", [], "n_shingles").join(texts, "rep")
        more = scratch.keep(tasks.groupBy("grp", "i", "j").applyInArrow(_block_links(shingle, percent), "u long, v long"))
        scratch.drop(texts, people, forest)
        comps = components(scratch, links.unionByName(more))
        scratch.drop(more)
    scratch.drop(loose)
    of = reps.join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    out = scratch.keep(of.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("rep_class")))
    scratch.drop(links, comps, reps)
    return out


_SET = "n_shingles long, d1 long, d2 long, sig binary"
_ON = ["d1", "d2", "n_shingles"]


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """Classes of documents linked at Jaccard similarity >= ``percent`` / 100.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns
    per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links, itself included), kept (doc_id = component_id).

    Null, empty and blank texts have an empty set, link with nothing and are
    kept. A text with fewer words than the shingle has its whole word sequence
    as its one shingle. Rows with a null doc_id take part under no id: they
    link with nothing and are returned with a null component_id and kept true.
    Rows that repeat a doc_id are returned as often as they come; each follows
    its own text. An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    signed = scratch.keep(small_batches(docs.select("text", "doc_id", "k")).mapInArrow(_signed(shingle), f"doc_id long, k long, {_SET}"))
    classes = _classes(scratch, docs, signed.where("doc_id is not null"), shingle, percent)
    of = signed.select("doc_id", *_ON).join(classes, _ON, "left")
    least = of.where("rep_class is not null").groupBy("rep_class").agg(F.min("doc_id").alias("cls"))
    out = of.join(least, "rep_class", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("cls", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each class stays, and every text without words.

    Links are those of ``near_duplicates``, but between rows: rows of one doc_id
    are told apart by their text, and rows with a null doc_id take part. Of a
    class the row of the smallest doc_id stays (one without an id only if no
    row has one), of several the one with the lowest hash of its columns, and of
    rows equal in all columns one. Columns are returned as they come; an
    empty table gives an empty result.
    """
    scratch = Scratch(spark)
    every = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*every).alias("row"), F.xxhash64(F.lit(1), *every).alias("h1"), F.xxhash64(F.lit(2), *every).alias("h2"))
    rows = named.select(F.col("row.text").cast("string").alias("text"), F.col("row.doc_id").cast("long").alias("doc_id"), "h1", "h2").withColumn("k", F.xxhash64("doc_id", "text"))
    signed = scratch.keep(small_batches(rows).mapInArrow(_signed(shingle), f"doc_id long, h1 long, h2 long, k long, {_SET}"))
    classes = _classes(scratch, rows, signed, shingle, percent)
    lines = signed.where("n_shingles > 0").groupBy("h1", "h2", "doc_id", *_ON).agg(F.count("*").alias("times")).join(classes, _ON)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")
    stays = lines.groupBy("rep_class").agg(F.min(order).alias("first"))
    lines = lines.join(stays, "rep_class").withColumn("stays", order == F.col("first"))
    # what does not simply stay
    marked = scratch.keep(lines.where("not stays or times > 1").select("h1", "h2", "stays"))
    scratch.drop(signed, classes)
    one = named.join(marked.select("h1", "h2"), ["h1", "h2"], "left_anti").select("row.*")
    again = marked.where("stays")
    if again.take(1):
        one = one.unionByName(named.join(again.select("h1", "h2"), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("row.*"))
    return one
