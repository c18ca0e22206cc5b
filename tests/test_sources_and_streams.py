import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import codecs, vocab
from textloom.plans import corpora
from textloom.sources import corpus
from textloom.streaming import window


def test_loaders(spark, tmp_path):
    long, short = "x" * 300, "y" * 30
    (tmp_path / "share.json").write_text(json.dumps([{"conversations": [{"value": long}, {"value": short}]}, {"conversations": None}]))
    assert [r.text for r in corpus.share_json(spark, str(tmp_path / "share.json")).collect()] == [long]
    pd.DataFrame({"conversation": [[{"content": long}, {"content": None}], None, []]}).to_parquet(tmp_path / "chat.parquet")
    assert [r.text for r in corpus.chat_parquet(spark, str(tmp_path / "chat.parquet")).collect()] == [long]
    (tmp_path / "d.csv").write_text(f'text\n"  {long}  "\n{short}\n')
    assert [r.text for r in corpus.dialogue_csv(spark, str(tmp_path / "d.csv")).collect()] == [long]
    (tmp_path / "t.jsonl").write_text('{"content": "a b"}\n"plain"\n\n')
    assert [r.text for r in corpus.turn_jsonl(spark, str(tmp_path / "t.jsonl")).collect()] == ["a b", "plain"]
    (tmp_path / "e.json").write_text(json.dumps({"chat_messages": [{"text": "", "content": [{"text": "q" * 15}, {"text": "r" * 15}], "sender": "human"}, {"text": "short", "sender": "human"}]}))
    assert [(r.role, r.text) for r in corpus.export_json(spark, str(tmp_path / "e.json")).collect()] == [("human", "q" * 15 + " " + "r" * 15)]


def test_binary_files(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(corpus.batch_file([b"one", b"", b"three"]))
    assert [bytes(r.data) for r in corpus.read_batches(spark, str(tmp_path / "b.bin")).collect()] == [b"one", b"", b"three"]
    with pytest.raises(codecs.CodecError):
        list(corpus.batch_items(b"\x09\x00\x00\x00ab"))
    (tmp_path / "v.bin").write_bytes(b"\0" * 8 + struct.pack("<II", 1, 2) + b"\x02hi" + struct.pack("<2f", 1.5, -2))
    assert [(r.word, list(r.vec)) for r in corpus.read_vectors(spark, str(tmp_path / "v.bin")).collect()] == [("hi", [1.5, -2.0])]
    entries = [codecs.Entry(b"abcd", 3, 6), codecs.Entry(b"\x00\xff\x01z", 9, 18)]
    (tmp_path / "d.bin").write_bytes(corpus.dictionary_file(entries))
    table = corpus.read_dictionary(spark, str(tmp_path / "d.bin"))
    assert [(bytes(r.pattern), r.freq, r.saving) for r in table.collect()] == [tuple(e) for e in entries]
    corpus.save_snapshot(table, str(tmp_path / "snap"), 5)
    assert sorted((r.version, bytes(r.pattern), r.freq, r.saving) for r in corpus.load_snapshot(spark, str(tmp_path / "snap")).collect()) == sorted((5, *e) for e in entries)
    tiers = vocab.tiers([table, table])
    corpus.save_tiers(tiers, str(tmp_path / "tiers"))
    assert corpus.load_tiers(spark, str(tmp_path / "tiers")).count() == tiers.count() == 4
    assert corpus.file_chunks(spark, str(tmp_path / "v.bin"), 10).count() == 3


def test_stream_equals_batch(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    turns.write.parquet(str(tmp_path / "in"))
    stream = window.session_vocabulary(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")))
    q = window.publish(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(240)
    got = {r.conv_id: r.entries for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    mined = vocab.mined(turns, ["conv_id", "turn"])
    want = {r.conv_id: r["count"] for r in vocab.window(mined, ["conv_id"], "turn").groupBy("conv_id").count().collect()}
    assert {k: v for k, v in got.items() if v} == want


def test_stream_rates(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    rates = window.call_rates(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert spark.table("rates").agg(F.sum("calls")).first()[0] == events.count()


def test_window_at_cap():
    w = window.SessionWindow(cap=1)
    w.update([codecs.Entry(b"aaaa", 3, 6)])
    assert not w.update([codecs.Entry(b"bbbb", 9, 18)])  # the old entry is too fresh to give way
    for _ in range(6):
        w.update([])
    assert w.update([codecs.Entry(b"bbbb", 9, 18)]) and list(w.entries) == [b"bbbb"]
    w.batches += 60
    w.evict()
    assert not w.entries


def test_files_of_bounded_size(spark, tmp_path):
    """A task of many rows writes several files, as a file is read as a whole; so does an export of many tasks."""
    rows = spark.range(2_500).selectExpr("cast(id as string) as word", "array(cast(id as float), 0.5f) as vec").coalesce(1)
    corpus.save_batches(rows, "word", str(tmp_path / "b"))
    corpus.save_vectors(rows, str(tmp_path / "v"))
    for there in ("b", "v"):
        assert len(list((tmp_path / there).glob("part-*"))) == 3
    assert sorted(int(bytes(r.data)) for r in corpus.read_batches(spark, str(tmp_path / "b")).collect()) == list(range(2_500))
    assert sorted((int(r.word), *r.vec) for r in corpus.read_vectors(spark, str(tmp_path / "v")).collect()) == [(i, i, 0.5) for i in range(2_500)]
    export = rows.repartition(3).selectExpr("array(struct(concat('word number ', word) as text, 'a' as sender)) as messages")
    path = corpora._array_file(export, str(tmp_path / "e"))
    files = list((tmp_path / "e").glob("part-*"))
    assert len(files) == 3 and sum(len(json.loads(f.read_text())) for f in files) == 2_500
    assert corpus.export_json(spark, path, 5).distinct().count() == 2_500
