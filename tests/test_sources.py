"""Readers, writers and streams."""

import json

import pytest

from corpusloom.operators import counts
from corpusloom.sources import readers, sinks
from corpusloom.streaming.counts import stream_core_word_counts


def test_corpus(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jsonl").write_text('{"text":"a"}\n{bad\n\n{"text":""}\n{"z":1}\n')
    (tmp_path / "a/y.txt").write_text("one\n\n  two \n")
    spark.createDataFrame([("p", 1), (None, 2), ("", 3)], "text string, n int").coalesce(1).write.parquet(str(tmp_path / "a/z"))
    got = readers.read_corpus(spark, str(tmp_path))
    assert sorted(r["text"] for r in got.collect()) == ["a", "one", "p", "two"]
    assert readers.read_corpus(spark, str(tmp_path), exclude="y.txt").count() == 2
    (tmp_path / "b").mkdir()
    assert readers.read_corpus(spark, str(tmp_path / "b")).count() == 0


def test_lists(spark, tmp_path):
    w = spark.createDataFrame([("క", 5), ("b", 9), ("a", 9)], "word string, n bigint")
    sinks.write_word_list(w, str(tmp_path / "w"))
    assert {tuple(r) for r in readers.read_word_list(spark, str(tmp_path / "w")).collect()} == {("క", 5), ("b", 9), ("a", 9)}
    (tmp_path / "odd.txt").write_text("x y\nalone\n3 c d\n")
    assert [tuple(r) for r in readers.read_word_list(spark, str(tmp_path / "odd.txt")).collect()] == [("c d", 3)]
    m = spark.createDataFrame([(0, "a", "b"), (1, "ab", "c")], "rank int, left string, right string")
    sinks.write_merges(m, str(tmp_path / "m"))
    part = next((tmp_path / "m").glob("part-*"))
    assert [tuple(r) for r in readers.read_merges(spark, str(part)).collect()] == [(0, "a", "b"), (1, "ab", "c")]
    sinks.write_counts(spark.createDataFrame([("క", 2)], "morpheme string, frequency bigint"), str(tmp_path / "c"))
    assert [tuple(r) for r in readers.read_counts(spark, str(tmp_path / "c")).collect()] == [("క", 2)]


def test_tokenizer(spark, tmp_path):
    v = spark.createDataFrame([("<pad>", 0), ("<unk>", 1), ("a", 4)], "token string, id int")
    text = sinks.tokenizer_json(v, spark.createDataFrame([(0, "a", "b")], "rank int, left string, right string"))
    (tmp_path / "tokenizer.json").write_text(text)
    r = readers.read_tokenizer(spark, str(tmp_path)).first()
    assert r["token_to_id"]["a"] == 4 and r["bpe_merges"] == [["a", "b"]] and r["special_tokens"] == {"<pad>": 0, "<unk>": 1}
    (tmp_path / "old.json").write_text(json.dumps({"token_to_id": {"a": 0}}))
    assert readers.read_tokenizer(spark, str(tmp_path / "old.json")).first()["version"] == "1.0"


def test_text_round_trip(spark, tmp_path):
    sinks.write_text(spark.createDataFrame([("a\nb",), (" ",), (None,)], "text string"), str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a b"]


def test_binary_stream(spark, tmp_path):
    import array

    blocks = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [5])], "block_id bigint, ids array<int>")
    sinks.write_stream_binary(blocks, str(tmp_path / "bin"))
    out = array.array("I")
    for f in sorted((tmp_path / "bin").iterdir()):
        out.frombytes(f.read_bytes())
    assert list(out) == [1, 2, 3, 4, 5]


def test_stages(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for p in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.staged(spark, str(tmp_path / "s"), p, make).count() == 3
    assert len(made) == 2


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([("కల మల",), ("కల",), (None,), ("",)], "text string")
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    stream = {tuple(r) for r in stream_core_word_counts(spark, str(tmp_path / "d"), state=str(tmp_path / "state")).collect()}
    assert stream == {tuple(r) for r in counts.core_word_counts(docs).collect()} == {("కల", 2), ("మల", 1)}


def test_limits(spark):
    d = spark.createDataFrame([(i, "s" if i % 2 else None, "కల మల") for i in range(10)], "doc_id bigint, source string, text string")
    assert sorted(r["doc_id"] for r in readers.first_per_source(d, 2).collect()) == [0, 1, 2, 3]
    assert sorted(r["doc_id"] for r in readers.budget_sample(d, 5).collect()) == [0, 1, 2]
    assert readers.subset(d, ["s", "unknown"]).count() == 5 and readers.subset(d, []).count() == 0


def test_bundle_and_metadata(spark, tmp_path):
    v = spark.createDataFrame([("<pad>", 0, 0, 0), ("క", 1, 1, 7), ("ab", 2, 2, 3)], "token string, id int, tier int, frequency bigint")
    sinks.write_tokenizer(v, spark.createDataFrame([(0, "a", "b")], "rank int, left string, right string"), str(tmp_path / "t"))
    assert (tmp_path / "t/vocab.txt").read_text() == "<pad>\nక\nab\n"
    assert (tmp_path / "t/token_frequencies.tsv").read_text() == "token_id\ttoken\tfrequency\n0\t<pad>\t0\n1\tక\t7\n"
    assert readers.read_tokenizer(spark, str(tmp_path / "t")).first()["bpe_merges"] == [["a", "b"]]
    row = spark.createDataFrame([(5, 256, 9, 1, 10, 0.5, "uint32")], readers.METADATA)
    sinks.write_metadata(row, str(tmp_path / "meta"))
    assert readers.read_metadata(spark, str(tmp_path / "meta")).collect() == row.collect()
    with pytest.raises(FileNotFoundError):
        readers.read_metadata(spark, str(tmp_path / "t/none")) if (tmp_path / "t/none").mkdir() is None else None


def test_segmented(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["క@@", "ల"], "s"), (2, ["x"], None)], "doc_id bigint, tokens array<string>, source string")
    sinks.write_segmented(rows, str(tmp_path / "p"), by="source")
    assert sorted(r["text"] for r in readers.read_segmented(spark, str(tmp_path / "p")).collect()) == ["x", "క@@ ల"]
    (tmp_path / "raw").mkdir(), (tmp_path / "none").mkdir(), (tmp_path / "seg/a").mkdir(parents=True)
    (tmp_path / "raw/a.txt").write_text("one two\n\n")
    (tmp_path / "seg/a/b.seg.txt").write_text("u@@ v\n")
    assert [r["tokens"] for r in readers.read_segmented(spark, str(tmp_path / "seg")).collect()] == [["u@@", "v"]]
    assert [r["tokens"] for r in readers.read_segmented(spark, str(tmp_path / "none"), str(tmp_path / "raw")).collect()] == [["one", "two"]]
    with pytest.raises(FileNotFoundError):
        readers.read_segmented(spark, str(tmp_path / "none"))
    sinks.write_json(rows.select("doc_id"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_sources_by_name(spark, tmp_path):
    (tmp_path / "v/tel").mkdir(parents=True)
    (tmp_path / "v/tel/a.txt").write_text("కల మల\nx\n")
    (tmp_path / "v/tel/b.jsonl").write_text('{"text": "కల"}\n')
    c = spark.createDataFrame([("s", "v/tel", 1e12), ("t", "gone", None), ("u", None, None)], "source string, data_dir string, approx_size_gb double")
    docs, missing = readers.load_sources(spark, c, str(tmp_path), ["s", "t", "u", "w"])
    assert {(r["text"], r["source"]) for r in docs.collect()} == {("కల మల", "s"), ("x", "s"), ("కల", "s")} and missing == ["t", "u", "w"]
    with pytest.warns(UserWarning, match="w"):
        assert readers.unknown_names(c, ["s", "w"]) == ["w"]
    assert [r["bytes"] for r in readers.largest_first(spark, str(tmp_path / "v")).orderBy("rank").collect()] == sorted([(tmp_path / "v/tel" / n).stat().st_size for n in ("a.txt", "b.jsonl")], reverse=True)
    got = readers.sample_of_files(spark, str(tmp_path / "v"), 1).collect()
    assert len(got) == 1 and got[0]["words"] in (1, 2) and readers.sample_of_files(spark, str(tmp_path / "v"), 100).count() == 2
    with pytest.warns(UserWarning, match="wanted"):
        assert sinks.disk_guard(spark, c, str(tmp_path))["enough"] is False


def test_binary_streams_come_back(spark, tmp_path):
    blocks = spark.createDataFrame([(k, list(range(4 * k, 4 * k + 4))) for k in range(9)], "block_id bigint, ids array<int>")
    sinks.write_stream_binary(blocks, str(tmp_path / "b"))
    rows = readers.read_stream_binary(spark, str(tmp_path / "b")).orderBy("first_block").collect()
    assert [x for r in rows for x in r["ids"]] == list(range(36)) and all(r["ids"][0] == 4 * r["first_block"] for r in rows)


def test_failing_texts_stay(spark):
    from corpusloom.functions import tolerant

    d = spark.createDataFrame([(1, "7"), (2, "x"), (3, None)], "doc_id bigint, text string")
    assert {tuple(r) for r in tolerant.map_texts(d, lambda x: str(int(x) + 1)).collect()} == {(1, "8", None), (2, "x", "ValueError"), (3, None, None)}


def test_counters_of_a_stage(spark):
    from pyspark.sql import functions as F

    from corpusloom.plans.metrics import Stage

    got = Stage("s", spark.range(10), rows=F.count(F.lit(1)), top=F.max("id")).run(lambda df: df.write.format("noop").mode("overwrite").save())
    assert (got["rows"], got["top"], got["stage"]) == (10, 9, "s") and got["rows_per_second"] > 0


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from corpusloom.plans import tables

    monkeypatch.setattr(tables, "HOT", 2)
    rows = spark.createDataFrame([(k, "h" if k < 5 else f"c{k % 2}") for k in range(8)] + [(9, None), (10, "none")], "id int, key string")
    other = spark.createDataFrame([("h", 5, "x"), ("c1", 2, "y"), ("c0", 1, "z")], "key string, n int, value string")
    for how, missing in (("left", [(9, None), (10, None)]), ("inner", [])):
        got = sorted((r["id"], r["value"]) for r in tables.join_counted(rows, other, ["key"], "n", how).collect())
        assert got == [(k, "x") for k in range(5)] + [(5, "y"), (6, "z"), (7, "y")] + missing
