"""Publishing versions, replayed and failed batches of the upsert, and pages beyond any fetch limit."""

from __future__ import annotations

import pytest

from daybill.sources import sinks
from daybill.sources.feeds import rss_items
from daybill.streaming.jobs import upsert_writer


def _batch(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, ord long")


def _writer(root):
    return upsert_writer(str(root), "id", ["title"], ["ord"])


def _ids(spark, root):
    return {r.id: r.title for r in sinks.read_published(spark, str(root)).collect()}


def test_upsert_over_batches(spark, tmp_path):
    write = _writer(tmp_path)
    for number, rows in enumerate([[("a", "A", 1), ("b", "B", 2)], [("c", "C", 3)], [("a", "A", 4)], [("a", "A2", 5), ("a", "A3", 6)]]):
        write(_batch(spark, rows), number)
    assert _ids(spark, tmp_path) == {"a": "A3", "b": "B", "c": "C"}
    assert sinks.published_version(spark, str(tmp_path)) == "0000000003"


def test_failed_read_fails_the_batch(spark, tmp_path, monkeypatch):
    write = _writer(tmp_path)
    write(_batch(spark, [("a", "A", 1), ("b", "B", 2)]), 0)

    def broken(*_):
        raise OSError("storage timeout")

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "read_published", broken)
        with pytest.raises(OSError):
            _writer(tmp_path)(_batch(spark, [("c", "C", 3)]), 1)
    assert _ids(spark, tmp_path) == {"a": "A", "b": "B"}
    write(_batch(spark, [("c", "C", 3)]), 1)
    assert _ids(spark, tmp_path) == {"a": "A", "b": "B", "c": "C"}


def test_replay_after_a_crash_before_the_pointer(spark, tmp_path):
    write = _writer(tmp_path)
    write(_batch(spark, [("a", "A", 1)]), 0)
    _batch(spark, [("half", "written", 9)]).write.parquet(f"{tmp_path}/version=0000000001")
    write(_batch(spark, [("b", "B", 2)]), 1)
    write(_batch(spark, [("z", "again", 2)]), 1)  # already published
    assert _ids(spark, tmp_path) == {"a": "A", "b": "B"}


def test_versions_are_never_rewritten(spark, tmp_path):
    sinks.publish_table(spark.range(3), str(tmp_path), "0002")
    with pytest.raises(ValueError):
        sinks.publish_table(spark.range(5), str(tmp_path), "0001")
    with pytest.raises(ValueError):
        sinks.read_published(spark, str(tmp_path / "none"))


def test_batches_share_folders(spark, tmp_path):
    gaps = spark.range(100).selectExpr("id", "id % 30 AS batch")
    assert sinks.write_batches(gaps, str(tmp_path), per_folder=10).count() == 30
    assert sorted(p.name for p in (tmp_path / "batches").iterdir() if p.is_dir()) == ["batch_range=0", "batch_range=1", "batch_range=2"]
    assert spark.read.json(str(tmp_path / "batches")).count() == 100


def test_every_landed_page_is_read(spark):
    body = "<rss><item><title>T</title></item></rss>"
    pages = spark.createDataFrame([("s", n, body) for n in (1, 40, 41, 400)], "source string, page_no int, body string")
    assert rss_items(pages).count() == 4


# --- streams, parts and gates


def _stream(spark, tmp_path, checkpoint, **more):
    """Run the upsert over what has landed, with this checkpoint."""
    rows = spark.readStream.schema("id string, title string, ord long, day string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    write = upsert_writer(str(tmp_path / "catalog"), "id", ["title"], ["ord"], checkpoint=str(checkpoint), **more)
    rows.writeStream.foreachBatch(write).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def _land(tmp_path, name, *rows):
    import json

    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("id", "title", "ord", "day"), r))) for r in rows))


def test_batches_behind_a_new_checkpoint_are_published(spark, tmp_path):
    _land(tmp_path, "1", ("a", "A", 1, "1997-06-01"))
    _land(tmp_path, "2", ("b", "B", 2, "1997-07-01"))
    _stream(spark, tmp_path, tmp_path / "one")
    _land(tmp_path, "3", ("c", "C", 3, "1997-07-02"))
    _land(tmp_path, "4", ("d", "D", 4, "1997-07-03"))
    _stream(spark, tmp_path, tmp_path / "two")  # starts anew at batch 0
    _land(tmp_path, "5", ("e", "E", 5, "1997-07-03"))
    _stream(spark, tmp_path, tmp_path / "two")
    assert set(_ids(spark, tmp_path / "catalog")) == set("abcde")


def test_versions_go_on_behind_a_named_one(spark, tmp_path):
    sinks.publish_table(_batch(spark, [("a", "A", 1)]).withColumn("content_hash", __import__("pyspark").sql.functions.lit("x")), str(tmp_path), "2026-01-01")
    write = _writer(tmp_path)
    write(_batch(spark, [("b", "B", 2)]), 0)
    write(_batch(spark, [("c", "C", 3)]), 1)
    write(_batch(spark, [("z", "replayed", 3)]), 1)
    assert set(_ids(spark, tmp_path)) == set("abc")
    assert sinks.next_version("2026-01-01~0000000004") == "2026-01-01~0000000005" and sinks.next_version("0000000007", 3) == "0000000008"


def _parts(tmp_path, version):
    return sorted(p.name for p in (tmp_path / "data" / f"version={version}").iterdir() if p.is_dir())


def test_an_upsert_rewrites_the_parts_it_touches(spark, tmp_path):
    from daybill.sources import partitioned

    root, month = str(tmp_path), partitioned.month("day")
    rows = [(f"r{i}", f"T{i}", f"1997-{i % 12 + 1:02d}-03") for i in range(60)] + [("none", "N", None)]
    catalog = spark.createDataFrame(rows, "id string, title string, day string")
    assert len(partitioned.upsert_parts(catalog, root, "id", month, "0001")) == 13
    one = spark.createDataFrame([("r5", "T5 again", "1997-06-03")], catalog.schema)
    assert partitioned.upsert_parts(one, root, "id", month, "0002") == ["1997-06"] and _parts(tmp_path, "0002") == ["_part=1997-06"]
    moved = spark.createDataFrame([("r6", "T6", "1998-01-09"), ("new", "New", "1997-06-04")], catalog.schema)
    assert partitioned.upsert_parts(moved, root, "id", month, "0003") == ["1997-06", "1997-07", "1998-01"]
    out = partitioned.upsert_parts(catalog.limit(0), root, "id", month, "0004", removed=spark.createDataFrame([("none",), ("absent",)], "id string"))
    assert out == ["none"] and "none" not in partitioned.manifest(spark, root)
    expected = {i: (t, d) for i, t, d in rows if i != "none"} | {"r5": ("T5 again", "1997-06-03"), "r6": ("T6", "1998-01-09"), "new": ("New", "1997-06-04")}
    assert {r.id: (r.title, r.day) for r in partitioned.read_parts(spark, root).collect()} == expected
    assert {r.id for r in partitioned.read_parts(spark, root, ["1998-01"]).collect()} == {"r6"}
    assert {r.title for r in partitioned.read_parts(spark, root, version="0001").filter("id = 'r5'").collect()} == {"T5"}


def test_a_failed_gate_leaves_the_old_version(spark, tmp_path):
    from daybill.operators import gates
    from daybill.sources import partitioned

    root, month = str(tmp_path), partitioned.month("day")
    no_image = lambda whole: gates.missing_images(whole)
    schema = "id string, image string, day string"
    partitioned.upsert_parts(spark.createDataFrame([("a", "x.jpg", "1997-06-03")], schema), root, "id", month, "0001", gates=no_image)
    with pytest.raises(gates.PublicationBlocked, match="images:b:no-image"):
        partitioned.upsert_parts(spark.createDataFrame([("b", "", "1997-06-04")], schema), root, "id", month, "0002", gates=no_image)
    assert sinks.published_version(spark, root) == "0001" and [r.id for r in partitioned.read_parts(spark, root).collect()] == ["a"]
    partitioned.upsert_parts(spark.createDataFrame([("b", "y.jpg", "1997-06-04")], schema), root, "id", month, "0002", gates=no_image)
    assert {r.id for r in partitioned.read_parts(spark, root).collect()} == {"a", "b"}
    with pytest.raises(gates.PublicationBlocked):
        sinks.publish_table(spark.createDataFrame([("c", "", "d")], schema), str(tmp_path / "whole"), "1", gates=no_image)
    assert sinks.published_version(spark, str(tmp_path / "whole")) is None


def test_a_stream_keeps_its_catalog_by_parts(spark, tmp_path):
    from daybill.sources import partitioned

    keep = dict(part="month", gates=None)
    rows = lambda *found: spark.createDataFrame(found, "id string, title string, ord long, month string")
    write = upsert_writer(str(tmp_path), "id", ["title"], ["ord"], **keep)
    write(rows(("a", "A", 1, "1997-06"), ("b", "B", 2, "1997-07")), 0)
    write(rows(("b", "B2", 3, "1997-07")), 1)
    write(rows(("b", "B2", 4, "1997-07")), 2)  # nothing new
    assert partitioned.manifest(spark, str(tmp_path)) == {"1997-06": "0000000000", "1997-07": "0000000001"}
    assert {r.id: r.title for r in partitioned.read_parts(spark, str(tmp_path)).collect()} == {"a": "A", "b": "B2"}
