import hashlib
from datetime import datetime
from pathlib import Path

import pytest

from shelfmark.operators.manifests import gate
from shelfmark.plans import restore
from shelfmark.sources import listings, snapshots

DAY = [datetime(2024, 1, d) for d in range(1, 10)]


@pytest.fixture
def tables(spark):
    pages = [(1, "http://old.example/a", ["http://old.example"]), (2, "x", None)]
    return {
        "web.pages": spark.createDataFrame(pages, "id int, url string, links array<string>"),
        "people.names": spark.range(10).toDF("id"),
    }


def data_files(root, snapshot_id, table):
    return sorted(Path(f"{root}/{snapshot_id}/data/{table}").glob("*.parquet"))


def spoil(path):
    """Change bytes at the end of a data file; the side file with Spark's own checksum goes along."""
    content = bytearray(path.read_bytes())
    content[-20] ^= 1
    path.write_bytes(bytes(content))
    side = path.with_name(f".{path.name}.crc")
    if side.exists():
        side.unlink()


def test_snapshot_of_chosen_apps_and_newest(spark, tmp_path, tables):
    root = str(tmp_path / "s")
    first = snapshots.write_snapshot(spark, tables, root, DAY[3])
    later = snapshots.write_snapshot(spark, tables, root, DAY[5], apps=["web"])
    snapshots.write_snapshot(spark, tables, root, DAY[4])
    newest = snapshots.newest_snapshot(spark, root).collect()
    assert [(r.path, r.tables) for r in newest] == [(later, ["web.pages"])]
    assert not Path(f"{root}/{later}/data/people.names").exists()
    assert snapshots.read_snapshot_table(spark, root, first, "people.names").count() == 10
    assert gate(snapshots.verify_snapshot(spark, root, first)).first().passed


def test_equal_second_falls_to_the_greater_id(spark, tmp_path, tables):
    root = str(tmp_path / "s")
    for name, micro in (("a", 900), ("b", 100)):
        snapshots.write_snapshot(
            spark, tables, root, DAY[1].replace(microsecond=micro), snapshot_id=name, apps=["web"]
        )
    assert snapshots.newest_snapshot(spark, root).first().path == "b"


def test_files_are_bounded_and_all_listed(spark, tmp_path, tables):
    root = str(tmp_path / "s")
    made = snapshots.write_snapshot(
        spark, {"people.names": tables["people.names"].coalesce(1)}, root, DAY[1], rows_per_file=3
    )
    files = data_files(root, made, "people.names")
    assert len(files) == 4
    manifest = {r.path: r.md5 for r in snapshots.read_manifest(spark, root, made).collect()}
    assert manifest == {f"people.names/{f.name}": hashlib.md5(f.read_bytes()).hexdigest() for f in files}
    lines = "".join(p.read_text() for p in Path(f"{root}/{made}/manifest").glob("*.txt")).splitlines()
    assert sorted(lines) == sorted(f"{md5}  {path}" for path, md5 in manifest.items())


@pytest.mark.parametrize("digests", [None, listings.streamed_digests])
def test_verification_sees_changed_and_lost_files(spark, tmp_path, tables, digests):
    root = str(tmp_path / "s")
    made = snapshots.write_snapshot(spark, tables, root, DAY[1], digests=digests)
    assert gate(snapshots.verify_snapshot(spark, root, made, digests=digests)).first().passed
    spoil(data_files(root, made, "web.pages")[0])
    data_files(root, made, "people.names")[0].unlink()
    verdict = gate(snapshots.verify_snapshot(spark, root, made, digests=digests)).first()
    assert (verdict.mismatch, verdict.missing, verdict.passed) == (1, 1, False)


# -- restore -------------------------------------------------------------------------

@pytest.fixture
def places(spark, tmp_path, tables):
    snaps, store = str(tmp_path / "snaps"), str(tmp_path / "store")
    source = snapshots.write_snapshot(spark, tables, snaps, DAY[2])
    restore.publish(spark, {"talk.lines": spark.range(3).toDF("id")}, store)
    return snaps, store, source


def run(spark, places, source_url="http://old.example", target_url="http://new.example"):
    return restore.checked_restore(spark, places[0], places[1], source_url, target_url, DAY[8])


def test_restore_rewrites_and_keeps_a_recovery_snapshot(spark, places):
    done = run(spark, places)
    assert done.source_id == places[2] and done.generation == 1
    now = restore.current_tables(spark, places[1])
    assert set(now) == {"web.pages", "people.names"} and now["people.names"].count() == 10
    page = now["web.pages"].where("id = 1").first()
    assert (page.url, page.links) == ("http://new.example/a", ["http://new.example"])
    saved = snapshots.read_snapshot_table(spark, done.recovery_root, done.recovery_id, "talk.lines")
    assert saved.count() == 3
    # The recovery snapshot lies below a folder of its own and is never the newest source.
    assert snapshots.newest_snapshot(spark, places[0]).first().path == places[2]
    again = run(spark, places)
    assert again.generation == 2 and again.source_id == places[2]
    old = snapshots.read_snapshot_table(spark, again.recovery_root, again.recovery_id, "web.pages")
    assert old.where("url = 'http://new.example/a'").count() == 1


@pytest.mark.parametrize("urls", [("", "http://n"), ("http://o", ""), (None, "http://n")])
def test_both_addresses_are_needed(spark, places, urls):
    with pytest.raises(restore.RestoreError):
        run(spark, places, *urls)


def unchanged(spark, store):
    now = restore.current_tables(spark, store)
    return set(now) == {"talk.lines"} and now["talk.lines"].count() == 3


def test_a_spoilt_source_stops_the_restore(spark, places):
    spoil(data_files(places[0], places[2], "web.pages")[0])
    with pytest.raises(restore.RestoreError, match="checksums"):
        run(spark, places)
    assert unchanged(spark, places[1])


def test_an_unsaved_present_state_stops_the_restore(spark, places, monkeypatch):
    whole = restore.write_snapshot

    def spoiling(spark, tables, root, now, **options):
        made = whole(spark, tables, root, now, **options)
        spoil(data_files(root, made, "talk.lines")[0])
        return made

    monkeypatch.setattr(restore, "write_snapshot", spoiling)
    with pytest.raises(restore.RestoreError, match="could not be saved"):
        run(spark, places)
    assert unchanged(spark, places[1])


def test_a_half_written_snapshot_is_never_chosen(spark, places, tables, monkeypatch):
    def fails(*args, **options):
        raise OSError("lost")

    monkeypatch.setattr(snapshots, "file_digests", fails)
    with pytest.raises(OSError):
        snapshots.write_snapshot(spark, tables, places[0], DAY[7])
    monkeypatch.undo()
    assert snapshots.newest_snapshot(spark, places[0]).first().path == places[2]


def test_no_source_snapshot(spark, tmp_path):
    store = str(tmp_path / "store")
    restore.publish(spark, {"talk.lines": spark.range(3).toDF("id")}, store)
    with pytest.raises(restore.RestoreError, match="no snapshot"):
        run(spark, (str(tmp_path / "nothing"), store))
    assert unchanged(spark, store)


def test_a_snapshot_of_nothing_is_refused(spark, tmp_path, tables):
    with pytest.raises(ValueError):
        snapshots.write_snapshot(spark, tables, str(tmp_path / "s"), DAY[1], apps=["maps"])


def test_of_two_rivals_for_a_generation_one_stops(spark, places):
    rows = spark.range(2).toDF("id")
    restore.publish(spark, {"a": rows}, places[1], 1)
    with pytest.raises(restore.RestoreError, match="taken"):
        restore.publish(spark, {"b": rows}, places[1], 1)
    assert set(restore.current_tables(spark, places[1])) == {"a"}
