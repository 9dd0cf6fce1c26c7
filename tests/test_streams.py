"""Streams over tables that are folders of files."""

import os

from spanloom.plans import PLANS

FOLDER = "/root/testdata/sf0.001"


def _in_folders(spark, tmp_path, table, rows=lambda df: df):
    rows(spark.read.parquet(f"{FOLDER}/{table}.parquet")).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    for name in os.listdir(FOLDER):
        if name != f"{table}.parquet":
            os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    return str(tmp_path)


def test_tables_in_folders_stream_whole(spark, tmp_path):
    folder = _in_folders(spark, tmp_path, "pages")
    for name in ("u05_batch_callback", "t01_discover_urls"):
        got, want = (sorted(PLANS[name](spark, f).collect()) for f in (folder, FOLDER))
        assert got == want and want


def test_no_url_to_hand_over(spark, tmp_path):
    folder = _in_folders(spark, tmp_path, "pages", lambda df: df.filter("url NOT LIKE 'https://%'"))
    assert PLANS["u05_batch_callback"](spark, folder).count() == 0
