import gzip
import json

from pyspark.sql import functions as F

from lexiquarry.operators import index as ix, search
from lexiquarry.sources import corpus as C
from lexiquarry.streaming.ingest import ingest

TEXT = "\nTitle one\nline a\n\nline b\n---END.OF.DOCUMENT---\nTitle two\n  ---END.OF.DOCUMENT---  \nTail\nbody"


def test_parse_corpus():
    assert C.parse_corpus(TEXT) == [("Title one", "line a\n\nline b")]
    assert C.parse_corpus(TEXT, flush_tail=True, keep_blank=False) == [("Title one", "line a\nline b"), ("Tail", "body")]
    assert C.parse_corpus("") == []
    assert C.parse_corpus("---END.OF.DOCUMENT---\nbody\n---END.OF.DOCUMENT---\n") == [("---END.OF.DOCUMENT---", "body")]


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "b.txt").write_text("T\nx\n---END.OF.DOCUMENT---\nU\ny\n---END.OF.DOCUMENT---\n")
    got = C.read_corpus(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"], r["content"]) for r in got] == [(0, "Title one", "line a\n\nline b"), (1, "T", "x"), (2, "U", "y")]


def test_wiki_content(spark):
    good = {"query": {"pages": [{"revisions": [{"slots": {"main": {"content": "'''A''' [[b|c]]"}}}]}]}}
    df = spark.createDataFrame([(json.dumps(good),), ("{}",), (None,)], "js string")
    assert [r[0] for r in df.select(C.wiki_content(F.col("js"))).collect()] == ["A c", None, None]


def test_gzip_round_trip(spark):
    df = spark.createDataFrame([("some text é",), ("",), (None,)], "t string").withColumn("z", C.compress("t")).withColumn("back", C.decompress("z"))
    rows = df.collect()
    assert [r["back"] for r in rows] == ["some text é", "", ""] and gzip.decompress(bytes(rows[0]["z"])).decode() == "some text é"


def test_ids_updates_and_csv(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a", "x"), (7, "b", "y")], "doc_id long, title string, content string")
    new = C.next_ids(docs, spark.createDataFrame([("n", "z"), ("m", "w")], "title string, content string"))
    ids = [r["doc_id"] for r in new.collect()]
    assert len(set(ids)) == 2 and min(ids) > 7
    after = C.update_content(docs, spark.createDataFrame([(7, "new"), (7, "later"), (99, "none")], "doc_id long, content string"))
    assert {(r["doc_id"], r["content"]) for r in after.collect()} == {(0, "x"), (7, "new")}
    C.write_csv(docs, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_stream_into_a_stored_index(spark, tmp_path):
    source, fields = str(tmp_path / "in"), "doc_id long, title string, content string"
    stream = lambda: spark.readStream.schema(fields).parquet(source)
    for batch in ([(1, "a", "one two"), (2, "b", "two")], [(3, "c", "two three")]):
        spark.createDataFrame(batch, fields).write.mode("append").parquet(source)
        ingest(stream(), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    stored = ix.Index.load(spark, str(tmp_path / "index"))
    assert {r["doc_id"] for r in search.exact_docs(stored, "two").collect()} == {1, 2, 3}
    assert stored.doc_stats.count() == 3
    again = [(2, "b", "four"), (5, "e", "two"), (5, "e", "one")]
    spark.createDataFrame(again, fields).write.mode("append").parquet(source)
    ingest(stream(), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    stored = ix.Index.load(spark, str(tmp_path / "index"))
    assert {r["doc_id"] for r in search.exact(stored, "two").collect()} == {1, 3, 5}
    assert {r["doc_id"] for r in search.exact(stored, "four").collect()} == {2} and stored.documents.count() == 4
