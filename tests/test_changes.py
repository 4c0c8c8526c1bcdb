from __future__ import annotations

import datetime as dt
import itertools
import json
import os
import time

import pytest
import seeds

from pulsemart import schemas
from pulsemart.operators import cdc, monitor, upsert
from pulsemart.plans import loads
from pulsemart.sources import changelog
from pulsemart.streaming import feed, progress
from pulsemart.streaming.triggers import DRAIN_ONCE


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def customer(i, op, version, **values):
    row = dict(
        customer_id=i, external_id=f"user{i}", first_name="F", last_name="L", middle_name=None, email=f"u{i}@example.com",
        phone=None, birth_date=None, region="europe", branch="B", created_at=1709251200000, updated_at="2024-03-01T10:00:00Z",
        __op=op, __table="customers", __source_ts_ms=version,
    )
    row.update(values)
    return json.dumps(row)


def device(i, op, version, **values):
    row = dict(
        prosthesis_id=i, serial_number=f"S{i}", model_id=1, customer_id=i, chip_id=f"chip-{i}", status="active",
        manufactured_date=19723, sold_date="2024-02-01", warranty_end_date=None, firmware_version="v1",
        created_at=1709251200000, updated_at=1709251200000, __op=op, __table="prostheses", __source_ts_ms=version,
    )
    row.update(values)
    return json.dumps(row)


def model(i, op, version, **values):
    row = dict(
        model_id=i, model_code=f"M{i}", model_name=f"Model {i}", category="arm", description=None, price=850000.5,
        warranty_months=24, is_active=1, created_at=1709251200000, __op=op, __table="models", __source_ts_ms=version,
    )
    row.update(values)
    return json.dumps(row)


def messages(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, seq long")


def test_decode_types(spark):
    d = cdc.decode(messages(spark, [device(1, "r", 5)]), "prostheses").first()
    assert (d.manufactured_date, d.sold_date, d.warranty_end_date) == (dt.date(2024, 1, 1), dt.date(2024, 2, 1), None)
    assert (d.created_at, d._version, d._deleted, d._reason) == (dt.datetime(2024, 3, 1), 5, False, None)
    m = cdc.decode(messages(spark, [model(1, "c", 1), model(2, "c", 1, is_active=False)]), "models").collect()
    assert [float(r.price) for r in m] == [850000.5] * 2 and [r.is_active for r in m] == [True, False]
    c = cdc.decode(messages(spark, [customer(1, "u", 1)]), "customers").first()
    assert c.updated_at == dt.datetime(2024, 3, 1, 10)


def test_bad_messages_are_kept_apart(spark):
    bad = ["{not json", "", "[1]", customer(None, "c", 1), customer("x", "c", 1), customer(2, "c", None)]
    good, dead = cdc.split_corrupt(cdc.decode(messages(spark, [customer(1, "c", 1), *bad]), "customers"))
    assert [r.customer_id for r in good.collect()] == [1]
    reasons = {r.value: r._reason for r in dead.collect()}
    assert len(reasons) == len(bad)
    assert reasons["{not json"] == "malformed"
    assert reasons[customer("x", "c", 1)] == "missing key"
    assert reasons[customer(2, "c", None)] == "missing version"
    assert set(good.columns) == set(schemas.change_state("customers").fieldNames())


def without(message, name):
    row = json.loads(message)
    del row[name]
    return json.dumps(row)


def test_each_fault_has_its_reason(spark):
    cases = {
        customer(1, "z", 1): "unknown operation",
        customer(2, None, 1): "unknown operation",
        customer(3, "u", "soon"): "wrong type: __source_ts_ms",
        customer(4, "u", 1, birth_date="yesterday"): "wrong type: birth_date",
        customer(5, "u", 1, created_at=99999999999999999): "out of range: created_at",
        customer(6, "u", 1, first_name={"a": 1}): "wrong type: first_name",
        customer(7, "u", 1, first_name=[1]): "wrong type: first_name",
        without(customer(8, "u", 1), "email"): "missing column: email",
        customer(9, "u", 1, region=None): "missing column: region",
        customer(10, "u", 1, first_name="{a brace is text}", last_name="[too", middle_name=5): None,
        without(customer(11, "d", 1, birth_date="yesterday", created_at=[2]), "email"): None,
        without(customer(12, "u", 1), "phone"): None,
    }
    got = {r.value: r._reason for r in cdc.decode(messages(spark, list(cases)), "customers").collect()}
    assert got == cases
    cases = {
        model(1, "u", 1, price="oops"): "wrong type: price",
        model(2, "u", 1, price=1e12): "wrong type: price",
        model(3, "u", 1, warranty_months="x"): "wrong type: warranty_months",
        model(4, "u", 1, is_active="yes"): "wrong type: is_active",
        model(5, "u", 1, warranty_months=None, is_active="TRUE"): None,
    }
    got = {r.value: r._reason for r in cdc.decode(messages(spark, list(cases)), "models").collect()}
    assert got == cases


def test_message_is_parsed_once(spark):
    """Checks add no second parse of good messages: one from_json, variants only inside a condition."""
    good, _ = cdc.split_corrupt(cdc.decode(messages(spark, [customer(1, "c", 1)]), "customers"))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


LOG = [
    customer(1, "r", 10, first_name="old"),
    customer(1, "u", 30, first_name="new"),
    customer(1, "u", 20, first_name="late"),  # arrives after a newer version
    customer(2, "c", 10),
    customer(2, "d", 20),
    customer(3, "c", 10),
    customer(3, "d", 20),
    customer(3, "c", 30, first_name="again"),
    customer(4, "u", 10, first_name="first"),
    customer(4, "u", 10, first_name="second"),  # same version: the later position counts
]


def log_of(spark, values):
    good, _ = cdc.split_corrupt(cdc.decode(messages(spark, values), "customers"))
    return good


def test_latest_and_live(spark):
    log = log_of(spark, LOG)
    last = by(upsert.latest(log, ["customer_id"], cdc.VERSION_ORDER), "customer_id")
    assert {k[0]: (r.first_name, r._deleted) for k, r in last.items()} == {
        1: ("new", False), 2: ("F", True), 3: ("again", False), 4: ("second", False),
    }
    assert set(by(cdc.current(log, "customers"), "customer_id")) == {(1,), (3,), (4,)}


def test_latest_ignores_input_order(spark):
    log = log_of(spark, LOG)
    expected = sorted(map(str, upsert.latest(log, ["customer_id"], cdc.VERSION_ORDER).collect()))
    for n in (1, 3):
        shuffled = log.orderBy("email", "_version", ascending=False).repartition(n)
        assert sorted(map(str, upsert.latest(shuffled, ["customer_id"], cdc.VERSION_ORDER).collect())) == expected


def test_latest_with_equal_versions_and_no_position(spark):
    log = log_of(spark, LOG).drop("_seq")
    a = upsert.latest(log, ["customer_id"], ["_version"]).collect()
    b = upsert.latest(log.repartition(5), ["customer_id"], ["_version"]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_replace_delete_retain(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    delta = spark.createDataFrame([(2, "B"), (3, "C"), (3, "D")], "k int, v string")
    assert sorted(r.v for r in upsert.replace(base, delta, ["k"], ["v"]).collect()) == ["B", "D", "a", "n"]
    gone = spark.createDataFrame([(1,), (9,)], "k int")
    assert sorted(r.v for r in upsert.delete(base, gone).collect()) == ["b", "n"]
    assert sorted(r.v for r in upsert.delete_where_in(base, "k", [1, 2]).collect()) == ["n"]
    dates = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "d date")
    assert [r.d for r in upsert.retain(dates, "d", 365, "2024-12-31 12:00:00").collect()] == [dt.date(2024, 1, 2)]


def test_touch(spark):
    at = dt.datetime(2024, 1, 1)
    base = spark.createDataFrame([(1, "a", None, at), (2, "b", None, at)], "k int, v string, w string, updated_at timestamp")
    delta = spark.createDataFrame([(1, "a", None, None), (2, "B", None, None), (3, "c", None, None)], base.schema)
    now = dt.datetime(2024, 2, 2)
    got = {r.k: r.updated_at for r in upsert.touch(base, delta, ["k"], now).collect()}
    assert got == {1: at, 2: now, 3: now}
    assert {r.updated_at for r in upsert.touch(base, delta, ["k"], now, always=True).collect()} == {now}


def test_insert_for_new_groups(spark):
    existing = spark.createDataFrame([("a", 1), ("a", 2)], "u string, n int")
    new = spark.createDataFrame([("a", 3), ("b", 1), ("b", 2)], "u string, n int")
    assert sorted(upsert.insert_for_new_groups(existing, new, ["u"]).collect()) == [("b", 1), ("b", 2)]


def test_files_upsert_delete_and_expire(spark, path):
    out = path + "/t"
    schema = "k int, v string, d date"
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)

    def put(rows):
        upsert.upsert_into(spark, out, spark.createDataFrame(rows, schema), ["k"], ["d"], ["k"])

    def files(d):
        return sorted(f for f in os.listdir(f"{out}/d={d}") if f.endswith(".parquet"))

    put([(1, "a", d1), (2, "b", d2), (3, "c", d2)])
    untouched = files(d1)
    put([(2, "B", d2), (4, "D", d2)])
    stored = spark.read.schema(spark.createDataFrame([], schema).schema)
    assert sorted((r.k, r.v) for r in stored.parquet(out).collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "D")]
    assert files(d1) == untouched
    put([(2, "B", d2), (4, "D", d2)])
    assert stored.parquet(out).count() == 4
    table_schema = spark.createDataFrame([], schema).schema
    upsert.delete_from(spark, out, spark.createDataFrame([(1,), (2,)], "k int"), table_schema, ["d"], ["k"])
    assert sorted(r.k for r in stored.parquet(out).collect()) == [3, 4]
    assert not os.path.exists(f"{out}/d={d1}")
    assert upsert.drop_expired(spark, out, table_schema, ["d"], "d", 90, "2024-04-01 00:00:00") == 1
    assert stored.parquet(out).count() == 0


def all_logs(spark, c, p, m):
    def one(values, entity):
        return cdc.split_corrupt(cdc.decode(messages(spark, values), entity))[0]

    return one(c, "customers"), one(p, "prostheses"), one(m, "models")


def test_customer_data(spark):
    c, p, m = all_logs(
        spark,
        [customer(1, "r", 1), customer(2, "r", 1), customer(3, "r", 1), customer(3, "d", 9)],
        [device(1, "r", 2), device(2, "r", 2), device(2, "u", 3, status="retired"), device(3, "r", 2), device(4, "r", 2, customer_id=1, chip_id=None)],
        [model(1, "r", 7)],
    )
    rows = by(cdc.customer_data(c, p, m), "prosthesis_id")
    assert set(rows) == {(1,)}
    assert rows[(1,)]._version == 7  # the model's, the newest of the three
    assert {r.prosthesis_id for r in cdc.customer_prosthesis(c, p, m).collect()} == {1, 4}


def write_messages(folder, entity, name, values):
    os.makedirs(f"{folder}/{entity}", exist_ok=True)
    with open(f"{folder}/{entity}/{name}.json", "w") as f:
        f.write("\n".join(values) + "\n")


def drain(query):
    assert query.awaitTermination(240)
    assert query.exception() is None


def test_stream_ingest(spark, path):
    log, dead = path + "/log", path + "/dead"

    def run(max_broken=None):
        stream = changelog.file_stream(spark, path + "/in/customers")
        drain(feed.ingest(stream, "customers", log, dead, path + "/cp", DRAIN_ONCE, max_broken))

    write_messages(path + "/in", "customers", "a", LOG[:4] + ["{broken"])
    run()
    write_messages(path + "/in", "customers", "b", LOG[4:])
    run()
    rows = feed.read_log(spark, log, "customers")
    assert rows.count() == len(LOG)
    assert [r._reason for r in spark.read.parquet(dead).collect()] == ["malformed"]
    state = sorted(map(str, cdc.current(rows, "customers").collect()))
    feed.compact_log(spark, log, "customers", upto=1)
    folded = feed.read_log(spark, log, "customers")
    assert folded.count() == 4
    assert sorted(map(str, cdc.current(folded, "customers").collect())) == state


def test_feed_delivered_twice_is_taken_in_once(spark, path):
    log, dead = path + "/log", path + "/dead"

    def run(within):
        stream = changelog.file_stream(spark, path + "/in/customers", max_files=1)
        query = feed.ingest(stream, "customers", log, dead, path + "/cp", DRAIN_ONCE, within=within)
        drain(query)
        return query.recentProgress

    write_messages(path + "/in", "customers", "a", [*LOG, "{broken", LOG[0]])
    run("1 day")
    write_messages(path + "/in", "customers", "b", [*LOG[3:], customer(9, "c", 1), "{broken"])
    write_messages(path + "/in", "customers", "c", [customer(9, "c", 1), customer(8, "c", 1)])
    run("1 day")
    assert sorted(r.customer_id for r in feed.read_log(spark, log, "customers").collect()) == [1, 1, 1, 2, 2, 3, 3, 3, 4, 4, 8, 9]
    assert [r.value for r in feed.read_dead_letters(spark, dead).collect()] == ["{broken"]


def test_state_of_deliveries_is_given_up(spark, path):
    seen = []
    write_messages(path + "/in", "customers", "a", LOG)
    time.sleep(0.1)
    for name in "bc":
        write_messages(path + "/in", "customers", name, [LOG[0]])
    stream = changelog.once(changelog.file_stream(spark, path + "/in/customers", max_files=1), "1 millisecond")
    query = stream.writeStream.foreachBatch(lambda b, _: seen.append(b.count())).option("checkpointLocation", path + "/cp")
    query = query.trigger(availableNow=True).start()
    drain(query)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == len(LOG)
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1


def test_later_file_wins_among_equal_versions(spark, path):
    write_messages(path + "/in", "customers", "z", [customer(1, "u", 5, first_name="zfirst")])
    write_messages(path + "/in", "customers", "a", [customer(1, "u", 5, first_name="later")])
    for name, seconds in (("z", 1_700_000_000), ("a", 1_700_000_100)):
        os.utime(f"{path}/in/customers/{name}.json", (seconds, seconds))
    rows = changelog.file_batch(spark, path + "/in/customers")
    for order in (rows, rows.orderBy("value"), rows.orderBy("value", ascending=False)):
        good, _ = cdc.split_corrupt(cdc.decode(order, "customers"))
        assert [r.first_name for r in cdc.current(good, "customers").collect()] == ["later"]


def test_progress_of_running_streams_fills_a_table(spark, path):
    log = progress.ProgressLog(spark, path + "/progress")
    spark.streams.addListener(log)
    try:
        write_messages(path + "/in", "customers", "a", LOG)
        stream = changelog.file_stream(spark, path + "/in/customers")
        drain(feed.ingest(stream, "customers", path + "/log", path + "/dead", path + "/cp", DRAIN_ONCE, within="1 day"))
        rates = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
        rate = rates.writeStream.format("noop").queryName("rates").option("checkpointLocation", path + "/cp2").start()
        deadline = time.time() + 60
        while time.time() < deadline and progress.read_progress(spark, path + "/progress").filter("query = 'rates' AND end_offset > 1").isEmpty():
            time.sleep(1)
        rate.stop()
    finally:
        spark.streams.removeListener(log)
    assert log.failed == 0
    last = progress.newest(progress.read_progress(spark, path + "/progress"))
    lags = {("Rate" in r.topic): (r.lag, r.status) for r in monitor.lag(last).collect()}
    assert lags == {True: (0, "healthy"), False: (None, "unknown")}
    rows = progress.throughput(progress.read_progress(spark, path + "/progress")).filter("query <> 'rates'").collect()
    assert sum(r.rows for r in rows) == len(LOG) and max(r.max_state_rows for r in rows) == len(LOG)


def test_replayed_log_batch_changes_nothing(spark, path):
    batch = messages(spark, LOG + ["{broken"])
    for _ in range(2):
        feed.write_log_batch(batch, 3, "customers", path + "/log", path + "/dead")
    assert feed.read_log(spark, path + "/log", "customers").count() == len(LOG)
    assert spark.read.parquet(path + "/dead").count() == 1
    with pytest.raises(feed.TooManyBrokenMessages):
        feed.write_log_batch(batch, 4, "customers", path + "/log", path + "/dead", max_broken=0)


@pytest.mark.parametrize("order", [0, 1])
def test_state_does_not_depend_on_batches(spark, path, order):
    log = log_of(spark, LOG)
    parts = [log.filter("_seq % 2 = 0"), log.filter("_seq % 2 = 1")]
    for part in parts if order == 0 else [parts[1], parts[0], parts[1]]:
        feed.apply_state(spark, part, "customers", path + "/state", buckets=4)
    state = feed.read_state(spark, path + "/state", "customers")
    expected = upsert.latest(log, ["customer_id"], cdc.VERSION_ORDER)
    assert sorted(map(str, state.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_stream_state(spark, path):
    write_messages(path + "/in", "customers", "a", LOG + ["{broken"])
    stream = changelog.file_stream(spark, path + "/in/customers")
    drain(feed.keep_state(stream, "customers", path + "/state", path + "/dead", path + "/cp", DRAIN_ONCE, buckets=2))
    assert [r.value for r in feed.read_dead_letters(spark, path + "/dead").collect()] == ["{broken"]
    live = upsert.live(feed.read_state(spark, path + "/state", "customers"))
    assert {r.customer_id for r in live.collect()} == {1, 3, 4}


def test_stream_dimension(spark, path):
    root = path + "/root"
    for entity in feed.ENTITIES:
        os.makedirs(f"{path}/in/{entity}", exist_ok=True)

    def run():
        streams = {e: changelog.file_stream(spark, f"{path}/in/{e}") for e in feed.ENTITIES}
        drain(feed.keep_dimension(streams, root, path + "/cp", DRAIN_ONCE, buckets=3))
        return by(feed.read_dimension(spark, root), "prosthesis_id")

    write_messages(path + "/in", "customers", "1", [customer(i, "r", 1) for i in (1, 2, 3)])
    write_messages(path + "/in", "prostheses", "1", [device(i, "r", 1) for i in (1, 2, 3)])
    write_messages(path + "/in", "models", "1", [model(1, "r", 1), model(2, "r", 1)])
    assert set(run()) == {(1,), (2,), (3,)}
    # a renamed model and customer are seen, though no device changed
    write_messages(path + "/in", "models", "2", [model(1, "u", 5, model_name="Renamed")])
    write_messages(path + "/in", "customers", "2", [customer(2, "u", 6, last_name="Moved")])
    rows = run()
    assert {r.prosthesis_model for r in rows.values()} == {"Renamed"}
    assert rows[(2,)].customer_name == "Moved F" and rows[(2,)]._version == 6
    # deleted customer, retired device
    write_messages(path + "/in", "customers", "3", [customer(1, "d", 9)])
    write_messages(path + "/in", "prostheses", "3", [device(3, "u", 9, status="retired"), "{broken"])
    rows = run()
    assert set(rows) == {(2,)}
    assert [r._reason for r in spark.read.parquet(f"{root}/dead/prostheses").collect()] == ["malformed"]
    state = {e: feed.read_state(spark, f"{root}/state/{e}", e) for e in feed.ENTITIES}
    anew = cdc.customer_data(state["customers"], state["prostheses"], state["models"])
    assert sorted(map(str, anew.collect())) == sorted(map(str, rows.values()))


def test_kafka_options():
    options = changelog.kafka_options("broker:9092", "models", max_offsets=1000, min_partitions=64)
    assert options["minPartitions"] == "64"
    assert options["subscribe"] == "crm.prosthesis_models"
    assert options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "1000"


def test_lag_rows_from_stream_progress():
    progress = {"sources": [{"endOffset": {"t": {"0": 5, "1": 7}}, "latestOffset": '{"t": {"0": 9, "1": 7}}'}, {"endOffset": None}]}
    assert changelog.kafka_progress(progress) == [("t", 0, 9, 5), ("t", 1, 7, 7)]


def test_change_load_falls_back_to_the_view(spark, path):
    as_of = dt.datetime(2024, 3, 5, 12)
    loads.load_hourly(spark, seeds.raw(spark), path + "/hourly", as_of)
    c, p, m = all_logs(spark, [customer(1, "r", 1)], [device(1, "r", 1)], [model(1, "r", 1)])
    dimension, view = cdc.customer_data(c, p, m), cdc.customer_prosthesis(c, p, m)
    for source, name in itertools.product([dimension, dimension.limit(0)], ["a"]):
        status = loads.change_load(spark, path + "/hourly", source, view, f"{path}/mart-{name}", as_of)
        assert (status["records_loaded"], status["affected_users"], status["status"]) == (2, 1, "success")
    nothing = loads.change_load(spark, path + "/hourly", dimension.limit(0), view.limit(0), path + "/mart-b", as_of)
    assert nothing["status"] == "no_data"
