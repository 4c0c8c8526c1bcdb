from __future__ import annotations

import datetime as dt
import json

import pytest
import seeds

from pulsemart.operators import profiles, publish, report, rollup
from pulsemart.sources import mart_store

D1, D2, D3 = dt.date(2024, 3, 5), dt.date(2024, 3, 6), dt.date(2024, 3, 9)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def mart(spark):
    row = seeds.mart_row
    return seeds.mart(
        spark,
        [
            row("ada", 1, D1, 8, avg_response_time=1.01, min_battery_level=30),
            row("ada", 1, D1, 9, avg_response_time=1.02, max_actuator_temp=50.0),
            row("ada", 4, D1, 9, movements_count=20, successful_movements=10, avg_response_time=2.0),
            row("ada", 1, D2, 10, customer_name="Ada New", error_count=5),
            row("ada", 1, D3, 10, customer_name="Ada New", error_count=0),
            # more successes than movements
            row("ben", 2, D1, 8, movements_count=10, successful_movements=12),
            # nothing moved
            row("cleo", 3, D1, 8, movements_count=0, successful_movements=0, success_rate=0.0, avg_battery_level=10.0),
        ],
    )


def test_daily_rollup(spark):
    rows = by(rollup.daily(mart(spark), weighted=True), "user_id", "prosthesis_id", "report_date")
    a = rows["ada", 1, D1]
    assert (a.total_movements, a.total_successful, a.daily_success_rate) == (20, 18, 90.0)
    assert (a.min_battery, a.max_temp, a.total_errors, a.active_hours) == (30, 50.0, 2, 2)
    assert a.avg_response_time == pytest.approx(1.015)
    assert rows["cleo", 3, D1].daily_success_rate == 0.0
    assert rows["cleo", 3, D1].weighted_response_time is None


def test_merging_parts_equals_the_whole(spark):
    devices = spark.createDataFrame(
        [("u1", 1, "c1"), ("u1", 2, "c2"), ("u2", 3, "c3")], "user_id string, prosthesis_id long, chip_id string"
    ).selectExpr("*", *[f"user_id {c}" for c in (
        "customer_name", "customer_email", "customer_region", "customer_branch", "prosthesis_model", "prosthesis_category", "prosthesis_serial")])
    rows = seeds.busy_mart(devices, "2024-03-08")
    parts = [rollup.daily_partials(rows.filter(f"pmod(report_hour, 3) = {i}")) for i in range(3)]
    merged = rollup.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), rollup.DAILY_KEYS)
    again = rollup.merge(merged, rollup.DAILY_KEYS)

    def shown(df):
        return sorted(str(r) for r in rollup.finish_daily(df).selectExpr("* except (avg_response_time)", "round(avg_response_time, 6) r").collect())

    assert shown(merged) == shown(rollup.daily_partials(rows)) == shown(again)


def test_user_daily_rates(spark):
    rows = by(report.user_daily(mart(spark)), "user_id", "prosthesis_serial", "report_date")
    assert rows["ben", "S2", D1].daily_success_rate == 100.0
    assert rows["cleo", "S3", D1].daily_success_rate is None
    assert rows["ada", "S1", D1].avg_response_time_ms == 1.02  # a tie, rounded up despite float noise


def test_user_daily_cdc(spark):
    dimension = spark.createDataFrame(
        [("old", "Old Owner", "M", "S1", "r", "chip-1", 1), ("ada", "Now Owner", "M", "S1", "r", "chip-1", 2)],
        "user_id string, customer_name string, prosthesis_model string, prosthesis_serial string, customer_region string, chip_id string, _version long",
    )
    rows = by(report.user_daily_cdc(mart(spark), dimension), "user_id", "customer_name", "report_date")
    assert rows["ada", "Now Owner", D1].daily_movements == 20
    assert rows["ada", None, D1].daily_movements == 20  # the device the dimension does not know
    assert rows["ben", None, D1].daily_success_rate == 120.0  # not capped here
    assert not any(name == "Old Owner" for _, name, _ in rows)


def test_summary(spark):
    rows = by(report.user_summary(mart(spark)), "user_id")
    a = rows[("ada",)]
    assert (a.customer_name, a.first_activity_date, a.last_activity_date) == ("Ada New", D1, D3)
    assert (a.total_days, a.active_days, a.total_movements, a.total_successful) == (5, 3, 60, 46)
    assert (a.overall_success_rate, a.total_errors, a.avg_errors_per_day) == (76.67, 8, 2.67)
    assert rows[("cleo",)].overall_success_rate == 0.0
    assert by(report.user_summary_view(mart(spark)), "user_id")[("cleo",)].overall_success_rate is None
    assert report.user_summary(report.for_user(mart(spark), "nobody")).count() == 0


def test_summary_from_stored_days(spark, path):
    rollup.daily_user(mart(spark)).write.parquet(path + "/days")
    stored = report.user_summary_from(spark.read.parquet(path + "/days"))
    assert sorted(map(str, stored.collect())) == sorted(map(str, report.user_summary(mart(spark)).collect()))


def test_list_pages(spark):
    rows = mart(spark)
    assert [r.report_date for r in report.report_list(rows, "ada").collect()] == [D3, D2, D1]
    assert [r.report_date for r in report.report_list(rows, "ada", limit=1, offset=1).collect()] == [D2]
    each = report.report_list(rows, limit=2, offset=1).filter("user_id = 'ada'")
    assert {r.report_date for r in each.collect()} == {D2, D1}
    for limit, offset in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            report.report_list(rows, limit=limit, offset=offset)


def test_list_document(spark):
    a = by(report.list_document(mart(spark), n=2), "user_id")[("ada",)]
    assert (a.total_reports, a.date_range.first_date, a.date_range.last_date) == (3, D1, D3)
    assert [(d.report_date, d.total_errors) for d in a.reports] == [(D3, 0), (D2, 5)]
    assert by(report.list_header(mart(spark)), "user_id")[("ada",)].total_reports == 3


def test_daily_document(spark):
    docs = [d for d in report.daily_document(mart(spark)).collect() if (d.user_id, d.report_date) == ("ada", D1)]
    assert {(d.total_movements, d.active_hours) for d in docs} == {(40, 2)}
    hours = sorted((h.hour, h.movements_count) for d in docs for h in d.hourly_stats)
    assert hours == [(8, 10), (9, 10), (9, 20)]
    assert all(d.hourly_stats == sorted(d.hourly_stats) for d in docs)


def test_documents_have_one_form_for_all_sizes(spark):
    devices = 37
    rows = seeds.mart(
        spark, [seeds.mart_row("fleet", d, D1, h) for d in range(devices) for h in range(24)] + [seeds.mart_row("ada", 1, D1, 1)]
    )
    docs = by(publish.documents(rows, "daily"), "object_key")
    folder = f"fleet/daily/{D1}"
    assert set(k for (k,) in docs) == {
        f"{folder}/report.json", *(f"{folder}/hours-{d}.json" for d in range(devices)),
        f"ada/daily/{D1}/report.json", f"ada/daily/{D1}/hours-1.json",
    }
    assert json.loads(docs[(f"{folder}/report.json",)].body)["total_movements"] == devices * 24 * 10
    hours = json.loads(docs[(f"{folder}/hours-36.json",)].body)["hourly_stats"]
    assert [h["hour"] for h in hours] == list(range(24))


def test_scope(spark):
    rows = mart(spark)
    grants = spark.createDataFrame([("ben", "cleo"), ("ben", "cleo"), ("boss", "ada")], "principal string, user_id string")

    def users(df):
        return sorted({r.user_id for r in df.collect()})

    assert users(report.scope(rows, "ada")) == ["ada"]
    assert users(report.scope(rows, "ben", grants)) == ["ben", "cleo"]
    assert report.scope(rows, "ben", grants).count() == 2
    assert users(report.scope(rows, "anyone", admin=True)) == ["ada", "ben", "cleo"]
    assert users(report.scope(rows, "nobody", grants)) == []


def test_rankings_and_fleet(spark):
    ranked = [(r.user_id, r.total_movements) for r in report.day_ranking(mart(spark), D1).collect()]
    assert ranked == [("ada", 40), ("ben", 10), ("cleo", 0)]
    days = report.fleet_daily(mart(spark), days=2).collect()
    assert [(d.report_date, d.users) for d in days] == [(D3, 1), (D2, 1)]
    rough = report.fleet_daily(mart(spark), days=None, approximate=True).collect()
    assert rough[-1].users == 3


def test_bands(spark):
    rows = spark.createDataFrame(
        [(95.0, 50.0, 0), (94.9, 49.9, 1), (85.0, 20.0, 4), (84.9, 19.9, 5)],
        "daily_success_rate double, avg_battery_level double, total_errors long",
    )
    got = [(r.success_band, r.battery_band, r.error_band) for r in report.bands(rows).collect()]
    assert got == [("good",) * 3, ("warn",) * 3, ("warn",) * 3, ("bad",) * 3]


def test_publish_read_and_missing(spark, path):
    out = path + "/docs"
    publish.refresh(spark, mart(spark), out)
    docs = by(publish.read(spark, out), "object_key")
    assert set(k for (k,) in docs if k.startswith("ada/") and "/hours-" not in k) == {
        "ada/list/reports.json",
        "ada/summary/summary.json",
        *(f"ada/daily/{d}/report.json" for d in (D1, D2, D3)),
    }
    body = json.loads(docs[(f"cleo/daily/{D1}/report.json",)].body)
    assert body["report_date"] == str(D1)
    hours = [json.loads(d.body)["hourly_stats"] for (k,), d in docs.items() if k.startswith(f"cleo/daily/{D1}/hours-")]
    assert min(h["hour"] for part in hours for h in part) == 8
    assert publish.read(spark, out, "daily", "ada").filter("prosthesis_id IS NULL").count() == 3
    wanted = spark.createDataFrame([("ada", D1), ("ada", dt.date(2024, 1, 1))], "user_id string, report_date date")
    assert [r.report_date for r in publish.missing(wanted, publish.read(spark, out, "daily")).collect()] == [dt.date(2024, 1, 1)]


def test_refresh_touches_only_affected_users(spark, path):
    out = path + "/docs"
    publish.refresh(spark, mart(spark), out)
    before = by(publish.read(spark, out), "object_key")
    changed = mart(spark).filter("not (user_id = 'ada' and report_date = date'2024-03-09')").filter("user_id <> 'cleo'")
    changed = changed.withColumn("error_count", changed.error_count + 1)
    users = spark.createDataFrame([("ada",), ("cleo",)], "user_id string")
    publish.refresh(spark, changed, out, users)
    after = by(publish.read(spark, out), "object_key")
    assert (f"ada/daily/{D3}/report.json",) not in after
    assert not any(k.startswith("cleo/") for (k,) in after)
    assert json.loads(after[(f"ada/daily/{D1}/report.json",)].body)["total_errors"] == 6
    ben = {k: v.body for k, v in before.items() if k[0].startswith("ben/")}
    assert ben == {k: v.body for k, v in after.items() if k[0].startswith("ben/")} and ben
    publish.refresh(spark, changed, out, users)
    assert by(publish.read(spark, out), "object_key") == after


def test_object_url(spark):
    row = spark.createDataFrame([("ada",)], "user_id string").select(
        publish.url("https://cdn.example/", publish.object_key("list")).alias("u")
    )
    assert row.first().u == "https://cdn.example/reports/ada/list/reports.json"


def test_mart_store(spark, path):
    out = path + "/mart"
    rows = mart(spark).drop("etl_processed_at")
    mart_store.load(spark, rows, out, "2024-03-10 00:00:00")
    first = sorted(map(str, mart_store.scan(spark, out).drop("etl_processed_at").collect()))
    mart_store.load(spark, rows, out, "2024-03-11 00:00:00")
    again = mart_store.scan(spark, out)
    assert sorted(map(str, again.drop("etl_processed_at").collect())) == first
    assert {str(r.etl_processed_at) for r in again.select("etl_processed_at").distinct().collect()} == {"2024-03-11 00:00:00"}
    mart_store.append(rows, out, "2024-03-12 00:00:00")
    assert mart_store.scan(spark, out).count() == 2 * len(first)
    assert mart_store.scan(spark, out, "ada", D2, D2).count() == 2
    assert mart_store.scan(spark, out, start=D2).select("report_date").distinct().count() == 2


def test_consent(spark):
    at = dt.datetime(2024, 3, 1)
    hour = dt.timedelta(hours=1)
    events = spark.createDataFrame(
        [
            (1, 7, "app", ["a"], "granted", at),
            (2, 7, "app", [], "revoked", at + hour),
            (3, 8, "app", ["a"], "revoked", at),
            (4, 8, "app", ["a", "b"], "granted", at),  # same time: the later id counts
        ],
        "id long, user_profile_id long, client_id string, scopes array<string>, action string, created_at timestamp",
    )
    now = by(profiles.current_consent(events), "user_profile_id")
    assert (now[(7,)].consent_given, now[(7,)].consent_scopes, now[(7,)].consent_given_at) == (False, None, at)
    assert (now[(8,)].consent_given, now[(8,)].consent_scopes) == (True, ["a", "b"])
    shown = profiles.consent_history(events, limit=1).collect()
    assert {(r.user_profile_id, r.action) for r in shown} == {(7, "revoked"), (8, "granted")}


def test_profiles_keep_older_values(spark):
    at = dt.datetime(2024, 3, 1)
    hour = dt.timedelta(hours=1)
    logins = spark.createDataFrame(
        [("k", "idp", "a@example.com", None, at), ("k", None, None, "Ann", at + hour), ("k", "idp", "old@example.com", "Old", at - hour)],
        "keycloak_user_id string, identity_provider string, email string, first_name string, last_login_at timestamp",
    )
    row = profiles.merge_profiles(logins).first()
    assert (row.identity_provider, row.email, row.first_name, row.last_login_at) == (None, "a@example.com", "Ann", at + hour)
