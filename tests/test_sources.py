import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark import session
from shelfmark.operators import manifests
from shelfmark.plans.seeding import load_record_files
from shelfmark.sources import listings, prepared, records

# Shapes of seed files, with invented values.
SCHEDULES = [
    {"model": "django_celery_beat.intervalschedule", "pk": 1, "fields": {"every": 30, "period": "seconds"}},
    {
        "model": "django_celery_beat.crontabschedule",
        "pk": 1,
        "fields": {"minute": "5", "hour": "3", "day_of_week": "*", "day_of_month": "*", "month_of_year": "*"},
    },
    {"model": "django_celery_beat.periodictasks", "pk": 1, "fields": {"last_update": "2020-02-03T04:05:06.789Z"}},
    {
        "model": "django_celery_beat.periodictask",
        "pk": 1,
        "fields": {
            "name": "cleanup", "task": "jobs.cleanup", "interval": None, "crontab": 1, "solar": None,
            "args": "[]", "kwargs": "{}", "queue": None, "exchange": None, "routing_key": None,
            "expires": None, "enabled": True, "last_run_at": None, "total_run_count": 0,
            "date_changed": "2020-02-03T04:05:06.789Z", "description": "",
        },
    },
    {
        "model": "django_celery_beat.periodictask",
        "pk": 2,
        "fields": {
            "name": "sync", "task": "jobs.sync", "interval": 1, "crontab": None, "solar": None,
            "args": "[1, \"a\"]", "kwargs": "{\"k\": 1}", "queue": None, "exchange": None, "routing_key": None,
            "expires": None, "enabled": False, "last_run_at": None, "total_run_count": 7,
            "date_changed": "2020-02-03T04:05:06.789Z", "description": "",
        },
    },
]


def profile(joined, email, username="admin"):
    return {
        "fields": {
            "date_joined": joined, "email": email, "first_name": "", "groups": [], "is_active": True,
            "is_staff": True, "is_superuser": True, "last_login": joined, "last_name": "",
            "password": "invented", "user_permissions": [], "username": username,
        },
        "model": "people.Profile",
        "pk": 1000,
    }


def array_file(path, items):
    path.write_text(json.dumps(items, indent=2))
    return str(path)


def test_mixed_array_file_is_typed_per_model(spark, tmp_path):
    read = records.read_records(spark, array_file(tmp_path / "s.json", SCHEDULES), array_files=True)
    assert read.count() == 5 and read.schema["fields"].dataType == T.StringType()
    tasks = {r.pk: r for r in records.typed(read, "django_celery_beat.periodictask").collect()}
    assert tasks[1].crontab == 1 and tasks[1].interval is None and tasks[2].interval == 1
    assert tasks[2].args == '[1, "a"]' and tasks[2].total_run_count == 7 and tasks[2].enabled is False
    assert records.typed(read, "django_celery_beat.intervalschedule").first().every == 30
    assert records.typed(read, "django_celery_beat.crontabschedule").first().hour == "3"
    assert records.typed(read, "sites.site").count() == 0


def test_every_known_model_has_a_schema():
    for fields in records.MODEL_FIELDS.values():
        assert T.StructType.fromDDL(fields).fields


def test_both_time_spellings_are_utc_in_any_session_zone(spark, tmp_path):
    items = [profile("2011-02-03 04:05:06", "a@b.example"), profile("2011-02-03T04:05:06.789Z", "c@d.example")]
    path = array_file(tmp_path / "p.json", items)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        rows = records.typed(records.read_records(spark, path, array_files=True), "people.Profile")
        millis = sorted(r.m for r in rows.select(F.unix_millis("date_joined").alias("m")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert millis == [1296705906000, 1296705906789]
    assert rows.first().groups == [] and rows.first().is_staff is True


def test_malformed_input_stops_the_job(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"model": "m", "pk": 1, "fields": {"a": 1}}\n{"model": "m", "pk": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed|parse"):
        records.read_records(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "type.json").write_text('{"model": "m", "pk": 1, "fields": {"a": {"x": 1}}}\n')
    read = records.read_records(spark, str(tmp_path / "type.json"))
    with pytest.raises(Exception, match="MALFORMED|malformed|parse"):
        records.typed(read, "m", "a bigint").collect()


def test_write_then_read_keeps_everything(spark, tmp_path):
    schema = (
        "id long, t string, n double, b boolean, at timestamp, plain timestamp_ntz, tags array<string>, "
        "inner struct<x:int,y:string>, nothing string"
    )
    rows = [
        (1, 'q"\\\n}é ', 0.1, True, datetime(2024, 1, 2, 3, 4, 5, 678901), datetime(2024, 1, 2, 3, 4, 5, 678901),
         ["a", None], (1, None), None),
        (None, "", None, None, None, None, [], None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "out")
    records.write_records(records.to_records(df, "a.b}", "id"), path)
    fields = schema.replace("id long, ", "").replace("timestamp_ntz", "timestamp")
    back = records.typed(records.read_records(spark, path), "a.b}", fields)
    wanted = df.withColumn("plain", F.col("plain").cast("timestamp")).withColumnRenamed("id", "pk")
    assert sorted(map(str, back.collect())) == sorted(map(str, wanted.collect()))
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert all(set(line) == {"model", "pk", "fields"} for line in lines)
    assert all("nothing" in line["fields"] for line in lines)


def test_folders_by_model_are_pruned_and_parsed_once(spark, tmp_path):
    path = str(tmp_path / "by")
    one = records.to_records(spark.range(5).withColumn("user", F.col("id") * 2), "a.key", "id")
    two = records.to_records(spark.range(3).withColumn("user", F.array(F.lit("x"))), "a.app", "id")
    records.write_records(one.unionByName(two), path, by_model=True)
    keys = records.read_model(spark, path, "a.key", "user bigint")
    assert sorted((r.pk, r.user) for r in keys.collect()) == [(i, 2 * i) for i in range(5)]
    apps = records.read_model(spark, path, "a.app", "user array<string>")
    assert [r.user for r in apps.collect()] == [["x"]] * 3
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "(model#" in plan.split("PartitionFilters: ")[1] and "from_json" not in plan
    mixed = records.typed(records.read_records(spark, path), "a.app", "user array<string>")
    assert mixed.count() == 3


def test_numbers_in_fields_keep_their_digits(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"model": "m", "pk": 1, "fields": {"v": 12345678901234567890.123456789}}\n')
    row = records.typed(records.read_records(spark, str(tmp_path / "n.json")), "m", "v decimal(38,9)").first()
    assert str(row.v) == "12345678901234567890.123456789"


def test_positions_follow_the_file_however_it_is_split(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = spark.range(0, 5000, 1, 1).select(F.lit(1).alias("pk"), F.col("id").alias("v"))
    records.write_records(records.to_records(rows, "m", "pk"), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = records.read_records(spark, path, positions=True)
        assert read.rdd.getNumPartitions() > 4
        ordered = records.typed(read, "m", "v bigint").orderBy("position").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.v for r in ordered] == list(range(5000))


def test_seed_files_load_in_order(spark, tmp_path):
    first = array_file(tmp_path / "1.json", [profile("2011-02-03 04:05:06", "sample@b.example")] + SCHEDULES)
    second = array_file(
        tmp_path / "2.json",
        [profile("2024-01-01T00:00:00.000Z", "no@b.example"), profile("2024-01-01T00:00:00.000Z", "real@b.example")],
    )
    loaded = load_record_files(spark, [first, second])
    assert loaded.columns == ["model", "pk", "fields"] and loaded.count() == 6
    assert records.typed(loaded, "people.Profile").first().email == "real@b.example"
    assert records.typed(load_record_files(spark, [second, first]), "people.Profile").first().email == "sample@b.example"


def test_prepared_records_have_the_fields_of_their_models(spark):
    df = spark.createDataFrame([(1, "HTTPS://Maps.Example:8443/")], "n int, url string")
    n, url, text = F.col("n"), F.col("url"), F.lit("t")
    at = F.lit("2024-01-02 03:04:05.6789").cast("timestamp_ntz")
    made = [
        prepared.site_records(df, n, url),
        prepared.application_records(
            df, n, name=text, site_url=url, redirect_path="in/index.html", client_id=text,
            client_secret=text, owner=F.lit("admin"), created=at,
        ),
        prepared.host_records(df, n, name=text, ip=F.lit("10.0.0.1")),
        prepared.service_records(df, n, name=text, url=url, host=n, service_type=n + 1),
        prepared.admin_records(
            df, n, username=text, email=text, password=text, now=datetime(2024, 1, 2, 3, 4, 5, 678900)
        ),
    ]
    rows = {}
    for frame in made:
        model = frame.first().model
        names = set(json.loads(frame.first().fields))
        assert names == set(T.StructType.fromDDL(records.MODEL_FIELDS[model]).names)
        rows[model] = records.typed(frame, model).first()
    assert (rows["sites.site"].domain, rows["sites.site"].name) == ("maps.example", "maps.example")
    app = rows["oauth2_provider.application"]
    assert app.redirect_uris == "HTTPS://Maps.Example:8443/in/index.html" and app.user == ["admin"]
    service = rows["monitoring.service"]
    assert (service.host, service.service_type, service.check_interval) == (1, 2, "00:01:00")
    assert str(rows["people.Profile"].last_login) == "2024-01-02 03:04:05.678000"


# -- listings ---------------------------------------------------------------------

@pytest.fixture
def tree(spark, tmp_path):
    for kind, n in (("vector", 2), ("raster", 3), ("time", 4), ("other/vector/deep", 5)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / "time" / "my tree+é" / kind))
    return str(tmp_path / "time" / "my tree+é")


@pytest.mark.parametrize("kind, rows", [("vector", 2), ("raster", 3), ("time", 4), ("point", 14), (None, 14)])
def test_import_by_kind(spark, tree, kind, rows):
    assert listings.import_by_kind(spark, tree, kind).count() == rows


def test_kinds_come_from_the_path(spark, tree):
    counts = {r.kind: r["count"] for r in listings.import_by_kind(spark, tree).groupBy("kind").count().collect()}
    assert counts == {"vector": 2, "raster": 3, "time": 4, None: 5}
    listed = {r.kind for r in listings.list_by_kind(spark, tree).collect()}
    assert listed == {"vector", "raster", "time", None}


@pytest.mark.parametrize(
    "path, root, below",
    [
        ("file:/x/a/x/b", "/x", "a/x/b"),
        ("hdfs://x/x/a", "/x/", "a"),
        ("hdfs://n:8020/x/a", "hdfs://n:8020/x", "a"),
        ("s3a://bucket/x/y/a", "s3a://bucket/x//y", "a"),
        ("s3a://bucket/a", "s3a://bucket", "a"),
        ("file:///x/a", "file:/x", "a"),
    ],
)
def test_relative_paths(spark, path, root, below):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(listings.relative_path(F.col("path"), root)).first()[0] == below


def test_relative_paths_need_an_absolute_root():
    with pytest.raises(ValueError):
        listings.relative_path(F.col("path"), "x/y")


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.fresh_dir(spark, "x").startswith(session.shared_dir(spark) + "/x-")


def test_listing_does_not_read_content(spark, tree):
    files = listings.list_by_kind(spark, tree, "raster")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema: ")[1]
    rows = [r for r in files.collect() if r.path.endswith(".parquet")]
    assert len(rows) == 1 and rows[0].kind == "raster" and rows[0].size > 0 and rows[0].mtime is not None


def test_digests_match_the_bytes(spark, tmp_path):
    import hashlib

    (tmp_path / "d" / "x").mkdir(parents=True)
    (tmp_path / "d" / "x" / "a.bin").write_bytes(b"abc")
    (tmp_path / "d" / "b.bin").write_bytes(b"\x00")
    (tmp_path / "d" / "empty.bin").write_bytes(b"")
    got = {r.path: r.md5 for r in listings.file_digests(spark, str(tmp_path / "d"), "*.bin").collect()}
    assert got == {"x/a.bin": hashlib.md5(b"abc").hexdigest(), "b.bin": hashlib.md5(b"\x00").hexdigest()}
    # Known limit: Spark's file sources pass over empty files.
    assert listings.list_files(spark, str(tmp_path / "d"), "*.bin").count() == 2


def test_the_whole_root_keeps_the_columns_of_all_kinds(spark, tmp_path):
    spark.range(2).select(F.col("id").alias("only_vector")).write.parquet(f"{tmp_path}/vector")
    spark.range(3).select(F.col("id").alias("only_raster")).write.parquet(f"{tmp_path}/raster")
    rows = listings.import_by_kind(spark, str(tmp_path))
    assert set(rows.columns) == {"only_vector", "only_raster", "kind"}
    assert rows.where("only_vector is not null and kind = 'vector'").count() == 2
    assert rows.where("only_raster is not null and kind = 'raster'").count() == 3


def test_every_file_is_walked_and_hashed(spark, tmp_path):
    import hashlib
    import subprocess

    contents = {"a.bin": b"a", "_b.bin": b"b", ".c.bin": b"c", "empty": b"", "_sub/d.bin": b"d", "sub/.deep/e f.bin": b"e"}
    contents["big.bin"] = bytes(range(256)) * 20_000  # several pieces
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    listed = {r.path: r.size for r in listings.walk_files(spark, str(tmp_path)).collect()}
    assert listed == {name: len(data) for name, data in contents.items()}
    digests = listings.streamed_digests(spark, str(tmp_path))
    assert {r.path: r.md5 for r in digests.collect()} == {n: hashlib.md5(d).hexdigest() for n, d in contents.items()}
    assert {r.path for r in listings.walk_files(spark, f"{tmp_path}/", "*.bin").collect()} == set(contents) - {"empty"}
    lines = [r.value for r in manifests.manifest_lines(digests).collect()] + ["# a comment", ""]
    said = subprocess.run(["md5sum", "-c"], input="\n".join(lines), cwd=tmp_path, capture_output=True, text=True)
    text = spark.createDataFrame([(line,) for line in lines], "value string")
    assert manifests.gate(manifests.verify_manifest(digests, manifests.parse_manifest_lines(text))).first().passed
    assert said.returncode == 0
    (tmp_path / "_b.bin").write_bytes(b"x")
    verdict = manifests.gate(manifests.verify_manifest(digests, manifests.parse_manifest_lines(text))).first()
    assert (verdict.mismatch, verdict.missing, verdict.passed) == (1, 0, False)


@pytest.mark.parametrize("budget", [1, 40, 20_000])
def test_walk_of_deep_and_crowded_folders(spark, tmp_path, budget):
    """A chain of folders, a crowded one, hidden and empty files, an empty folder; any budget sees all."""
    wanted = set()
    depth = 12 if budget == 1 else 60
    for name in ["/".join(["d"] * n) + "/f" for n in range(1, depth)] + [f"crowd/{k:04}" for k in range(400)] + [f"crowd/s{k}/.h" for k in range(9)]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name.endswith("7") else "x")
        wanted.add(name)
    (tmp_path / "nothing").mkdir()
    (tmp_path / "_top").write_text("")
    wanted.add("_top")
    rows = listings.walk_files(spark, str(tmp_path), budget=budget).collect()
    assert len(rows) == len(wanted) and {r.path for r in rows} == wanted
    assert all(r.size == (not r.path.endswith("7") and r.path != "_top") and r.mtime is not None for r in rows)
    hidden = listings.walk_files(spark, str(tmp_path), ".h", budget).collect()
    assert {r.path for r in hidden} == {n for n in wanted if n.endswith(".h")}


def test_walk_of_an_empty_folder(spark, tmp_path):
    assert listings.walk_files(spark, str(tmp_path)).count() == 0
