"""Tables kept as runs: what a batch writes and reads, merges, and batches run again."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from test_changes import customer, device, model

from pulsemart import schemas
from pulsemart.operators import cdc, upsert
from pulsemart.sources import runs
from pulsemart.streaming import feed

SCHEMA = schemas.struct("k BIGINT, v STRING, n BIGINT")


def newest(rows):
    return upsert.latest(rows, ["k"], ["n"])


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def rows_of(spark, first, last, n):
    return spark.range(first, last).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id") * n).alias("v"), F.lit(n).cast("long").alias("n"))


def content(df):
    return sorted(map(tuple, newest(df.drop("bucket")).collect()))


def test_a_batch_writes_what_it_holds(spark, path):
    runs.add(rows_of(spark, 0, 50_000, 1), path, ["k"], 8, 0)
    whole = size(path)
    runs.add(rows_of(spark, 7, 9, 2), path, ["k"], 8, 1)
    assert size(path) - whole < whole / 50
    assert {r.n for r in newest(runs.read(spark, path, SCHEMA).drop("bucket")).filter("k IN (7, 8)").collect()} == {2}
    again = content(runs.read(spark, path, SCHEMA))
    runs.add(rows_of(spark, 7, 9, 2), path, ["k"], 8, 1)
    assert len(runs.runs(spark, path)[0]) == 2 and content(runs.read(spark, path, SCHEMA)) == again


def test_merges_keep_content_and_bound_runs(spark, path):
    before = []
    for n in range(12):
        runs.add(rows_of(spark, n, n + 5, n), path, ["k"], 2, n)
        before = content(runs.read(spark, path, SCHEMA))
        runs.merge(spark, path, SCHEMA, ["k"], newest, fanout=3)
        assert content(runs.read(spark, path, SCHEMA)) == before
        assert len(runs.runs(spark, path)[0]) <= 3
    held = [d for d in os.listdir(path) if d.startswith("run=")]
    assert len(held) < 8  # replaced runs go with the next merge
    assert sum(r.n >= 0 for r in runs.read(spark, path, SCHEMA).collect()) < 12 * 5  # old versions went with merges


def test_unfinished_and_replaced_runs(spark, path):
    for n in range(3):
        runs.add(rows_of(spark, 0, 4, n), path, ["k"], 2, n)
    os.remove(f"{path}/run=b{2:020d}/_SUCCESS")
    assert max(r.n for r in runs.read(spark, path, SCHEMA).collect()) == 1
    old = runs.read(spark, path, SCHEMA)
    assert runs.merge(spark, path, SCHEMA, ["k"], newest, fanout=2) == 1
    assert content(old) == content(runs.read(spark, path, SCHEMA))  # a reader that began before still finds its files
    assert not os.path.exists(f"{path}/run=b{2:020d}")
    # a batch that is run again after its run was merged brings nothing back
    runs.add(rows_of(spark, 0, 4, 0), path, ["k"], 2, 0)
    assert {r.n for r in newest(runs.read(spark, path, SCHEMA).drop("bucket")).collect()} == {1}


def test_tiers_go_by_size(spark, path, monkeypatch):
    monkeypatch.setattr(runs, "SMALL", 4096)
    runs.add(rows_of(spark, 0, 100_000, 0), path, ["k"], 1, 0)
    for n in range(1, 3):
        runs.add(rows_of(spark, n, n + 2, n), path, ["k"], 1, n)
    assert runs.merge(spark, path, SCHEMA, ["k"], newest, fanout=2) == 1
    assert f"run=b{0:020d}" in runs.runs(spark, path)[0]  # the large run is not written again for two small ones


def batch(spark, **values):
    rows = [(v, i, e) for e in feed.ENTITIES for i, v in enumerate(values.get(e, []))]
    return spark.createDataFrame(rows, "value string, seq long, entity string")


def dimension(spark, root):
    return sorted(map(str, feed.read_dimension(spark, root).collect()))


def anew(spark, root):
    state = {e: feed.read_state(spark, f"{root}/state/{e}", e) for e in feed.ENTITIES}
    return sorted(map(str, cdc.customer_data(state["customers"], state["prostheses"], state["models"]).collect()))


BATCHES = [
    dict(customers=[customer(i, "r", 1) for i in range(40)], prostheses=[device(i, "r", 1, model_id=i % 3) for i in range(40)],
         models=[model(i, "r", 1) for i in range(3)]),
    dict(customers=[customer(5, "u", 3, last_name="Moved")]),
    dict(prostheses=[device(6, "u", 4, customer_id=5)]),  # changes hands
    dict(customers=[customer(6, "u", 5, last_name="Without"), customer(5, "u", 6, last_name="Two")]),
    dict(models=[model(1, "u", 7, model_name="Renamed")], prostheses=[device(7, "d", 8)]),
    dict(customers=[customer(5, "d", 9)]),
    dict(customers=[customer(5, "c", 10)], prostheses=[device(50, "c", 2, customer_id=5), "{broken"]),
]


@pytest.fixture
def kept(spark, path):
    for n, values in enumerate(BATCHES):
        feed.apply_feed_batch(batch(spark, **values), n, path, buckets=16)
    return path


def test_dimension_equals_one_made_anew(spark, path):
    for n, values in enumerate(BATCHES):
        for _ in range(2 if n % 3 == 2 else 1):  # some batches are run twice
            feed.apply_feed_batch(batch(spark, **values), n, path, buckets=16)
        assert dimension(spark, path) == anew(spark, path)
        if n == 4:
            feed.merge_feed(spark, path, fanout=2)
            assert dimension(spark, path) == anew(spark, path)


def scans(df):
    """The partition filters of the file scans of a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [line[line.index("PartitionFilters") :].split("PushedFilters")[0] for line in lines if "FileScan" in line]


def test_a_batch_reads_the_buckets_of_its_keys(spark, kept):
    changed = spark.createDataFrame([(5,)], "customer_id int")
    none = {"prostheses": spark.createDataFrame([], "prosthesis_id int"), "models": spark.createDataFrame([], "model_id int")}
    hit = feed.affected_devices(spark, {"customers": changed, **none}, kept, buckets=16)
    assert {r.prosthesis_id for r in hit.collect()} == {5, 6, 50}
    number = changed.select(runs.bucket(["customer_id"], 16).alias("b")).first().b
    index = runs.lookup(spark, f"{kept}/index/customers", feed.index_schema("customer_id"), "customer_id", changed, 16)
    assert [f"bucket#" in s and f"= {number})" in s for s in scans(index)] == [True]
    for entity in feed.ENTITIES:
        keys = spark.createDataFrame([(2,)], f"{schemas.CHANGE_KEYS[entity][0]} int")
        found = feed.lookup_state(spark, f"{kept}/state/{entity}", entity, keys, 16)
        filters = scans(found)
        assert filters and all("bucket#" in s and "= " in s for s in filters)
    rows = feed.dimension_rows(spark, hit, kept, 16)
    filters = scans(rows)
    assert len(filters) >= 3 and all("bucket#" in s for s in filters)  # all three states, and the indexes, are pruned


def test_a_small_batch_writes_little(spark, path):
    many = dict(
        customers=[customer(i, "r", 1) for i in range(3000)], prostheses=[device(i, "r", 1) for i in range(3000)], models=[model(1, "r", 1)]
    )
    feed.apply_feed_batch(batch(spark, **many), 0, path, buckets=4)
    whole = size(path)
    feed.apply_feed_batch(batch(spark, customers=[customer(9, "u", 2, last_name="New")]), 1, path, buckets=4)
    assert size(path) - whole < whole / 10
    assert {r.customer_name for r in feed.read_dimension(spark, path).filter("customer_id = 9").collect()} == {"New F"}
