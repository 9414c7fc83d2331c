"""What holds on small tables holds on larger ones: long archives, long spans of time, rare pictures, and the work a picture takes."""

from __future__ import annotations

import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import flow, images, imaging, kernels
from framequarry.plans import catalogue
from framequarry.sources import jpeg, zipimages


def test_a_bundle_lists_more_entries_than_an_upload_may_have(spark, tmp_path):
    rows = spark.range(zipimages.MOST_ENTRIES + 5).select(F.lit(3).alias("job"), F.format_string("p%06d.txt", "id").alias("name"), F.lit(b"x").alias("body"))
    assert [(r["job"], r["entries"], r["bytes"]) for r in flow.write_bundles(rows, str(tmp_path)).collect()] == [("3", 20005, 20005)]
    refused = spark.read.format("zipimages").option("read", "names").load(f"{tmp_path}/*.zip").collect()
    assert [r["code"] for r in refused] == ["too_many_images"]


def _compared(name: str, spark, folder: str, table: str) -> tuple[list, list]:
    df = catalogue.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(found, key=repr)


def test_jpeg_pictures_that_are_not_near(spark, tmp_path):
    levels = np.random.default_rng(45290).integers(0, 256, (8, 8, 3))
    far = np.abs(np.rint(jpeg.decode(jpeg.encode(levels.astype(np.uint8), 95))[0] * 255) - levels).max()
    assert far == 26
    rows = [(k, [float(v) for v in levels[..., k].ravel() / 255 - 0.5]) for k in range(3)] + [(k, [0.1] * 64) for k in (3, 4, 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, wanted = _compared("jpeg_pictures", spark, str(tmp_path), "embeddings")
    assert got == wanted and [r[-1] for r in got] == [False, True]


@pytest.mark.parametrize("name", ["governed_stream", "stopped_stream"])
def test_streams_over_more_than_a_month(spark, small, tmp_path, name):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("event_id", F.col("event_id") * 9_001)
    events.write.parquet(f"{tmp_path}/events.parquet")
    got, wanted = _compared(name, spark, str(tmp_path), "events")
    assert len(got) == events.count() and got == wanted


def _calls(step) -> int:
    """Calls that a step makes, once what it keeps is there."""
    step()
    count = 0

    def seen(frame, event, arg):
        nonlocal count
        count += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        step()
    finally:
        sys.setprofile(None)
    return count


@pytest.mark.parametrize("step, most", [(imaging.keyed, 900), (imaging.plate_measures, 450), (imaging.placed, 270), (imaging.traced_edge, 350), (imaging.clipping_path, 1300)])
def test_a_picture_takes_few_calls(step, most):
    picture = imaging.render(30, 1, True, True)
    assert _calls(lambda: step(*picture)) < most


def test_runs_are_what_a_flood_fill_finds():
    rng = np.random.default_rng(5)
    for n in range(60):
        mask, diagonal = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.5, bool(n % 2)
        steps = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y or x) and (diagonal or not (y and x))]
        labels, number = np.zeros(mask.shape, int), 0
        for start in map(tuple, np.argwhere(mask)):
            if labels[start]:
                continue
            number += 1
            labels[start], todo = number, [start]
            while todo:
                y, x = todo.pop()
                for at in ((y + dy, x + dx) for dy, dx in steps):
                    if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and mask[at] and not labels[at]:
                        labels[at] = number
                        todo.append(at)
        runs = kernels.Runs(mask, diagonal)
        assert np.array_equal(runs.painted(runs.labels), labels) and runs.sizes().tolist() == np.bincount(labels.ravel(), minlength=number + 1)[1:].tolist()


def test_rows_keep_their_results_where_batches_are_cut(spark):
    rows = spark.range(40).coalesce(1)

    def step(row: dict) -> dict:
        if row["id"] % 7 == 3:
            raise images.Failed("no_foreground_found", str(row["id"]), {"made": row["id"]})
        return {"made": row["id"], "body": bytes([row["id"]]) * (1 << 20 if row["id"] % 5 == 0 else 1)}

    for r in images.each_image(rows, step, "made bigint, body binary").selectExpr("id", "made", "substring(body, 1, 1) as first", "length(body) as n", "error.message as told").collect():
        failed = r["id"] % 7 == 3
        assert (r["made"], r["told"], r["n"]) == (r["id"], str(r["id"]) if failed else None, None if failed else 1 << 20 if r["id"] % 5 == 0 else 1)
        assert failed or r["first"][0] == r["id"]
