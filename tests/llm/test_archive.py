"""Archives that roll by compressed size, tasks that are lost after their rename, and where archives may lie."""

import os

import pytest

from plazafeed.llm import warc
from plazafeed.llm.common import new_dir

SCHEMA = "page_id long, url string, html string"


def pages(spark, n=400):
    rows = [(i, f"https://p/{i}", "".join(f"<p>{(i * 7919 + k * 104729) % 999983}" for k in range(60))) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_files_roll_by_compressed_size(spark):
    root = new_dir(spark, "warc")
    manifest = warc.write_archive(pages(spark), root, roll_bytes=20_000, shard_bytes=120_000).collect()
    largest = max(m.n_bytes / m.n_records for m in manifest)
    assert len(manifest) > 5 and all(m.n_bytes < 20_000 + 4 * largest for m in manifest)
    # inside a shard a file is closed by its size: more files than shards, most of them full
    assert sum(m.n_bytes >= 20_000 for m in manifest) > len(manifest) / 2
    assert warc.read_archive(spark, root).count() == 400


def test_a_lost_attempt_leaves_the_archive_as_it_is(spark):
    """A task that fails after its rename leaves a file that the repeated task renames onto, or one that no manifest names."""
    root = new_dir(spark, "warc")
    warc.write_archive(pages(spark, 50), root)
    shard = warc._Shard(root, 1 << 20, 6)
    shard.add(7, warc._record(7, "u", b"lost", "0" * 40, None, "2024-01-31T00:00:00Z"))
    shard.close()
    assert warc.read_archive(spark, root).count() == 50
    again = new_dir(spark, "warc")
    first = {m.file for m in warc.write_archive(pages(spark, 50), again).collect()}
    assert first == {m.file for m in warc.read_manifest(spark, root).collect()}


def test_paths_have_the_scheme_that_spark_takes(spark, tmp_path, monkeypatch):
    assert warc._qualified(spark, str(tmp_path)) == f"file://{tmp_path}" == warc._qualified(spark, f"file://{tmp_path}")
    monkeypatch.chdir(tmp_path)
    assert warc._qualified(spark, "file:///x/y") == "file:///x/y" and os.path.isabs(warc._qualified(spark, "here")[7:])
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError):
        warc._qualified(spark, "file:///elsewhere/archive")
    shared = spark.conf.get("spark.checkpoint.dir")
    assert warc._qualified(spark, f"{shared}/archive").endswith("/archive")
