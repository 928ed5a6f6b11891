"""The split array reader against the plain one, whatever the ranges cut."""

import json
import random

import pytest

from shelfmark.sources import arrays, records


def text_of(rnd):
    return "".join(rnd.choices(['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "😀", "a", " ", '"}', "\\\\", '\\"}', '{"pk": 1}'], k=rnd.randint(0, 9)))


def made_up(rnd, n):
    out = []
    for k in range(n):
        nested = {"in": {"deep": [1, {"x": text_of(rnd)}, []]}, text_of(rnd): None}
        out.append({"model": rnd.choice(["a.b", "c.d"]), "pk": k, "fields": {"name": text_of(rnd), "more": rnd.choice([nested, {}, [text_of(rnd)], None])}})
    return out


@pytest.fixture
def ranges(spark, monkeypatch):
    """Sets the size of the ranges that the files are read in, and of nothing else."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    write, tasks = arrays._stored, []

    def of(size):
        def written(df, label):
            for n, v in zip(names, (size, 1)) if label == "array-pieces" else ():
                spark.conf.set(n, str(v))
            if label == "array-pieces":
                tasks.append(df.rdd.getNumPartitions())
            path = write(df, label)
            for n, v in before.items():
                spark.conf.set(n, v)
            return path

        monkeypatch.setattr(arrays, "_stored", written)
        return tasks

    return of


def found(spark, path):
    rows = arrays.read_array_records(spark, path, positions=True).collect()
    return [(r.model, r.pk, json.loads(r.fields)) for r in sorted(rows, key=lambda r: r.position)]


@pytest.mark.parametrize("size", [7, 23, 900])
def test_any_range_gives_whole_records(spark, tmp_path, ranges, size):
    rnd = random.Random(size)
    wanted = made_up(rnd, 12 if size < 20 else 25)
    layouts = [json.dumps(wanted), json.dumps(wanted, indent=2, ensure_ascii=False), json.dumps(wanted, separators=(",", ":")) + "\n\n"]
    for i, text in enumerate(layouts[:: 3 if size < 100 else 1]):
        path = tmp_path / f"{i}.json"
        path.write_text(text, encoding="utf-8")
        tasks = ranges(size)
        assert found(spark, str(path)) == [(r["model"], r["pk"], r["fields"]) for r in wanted]
        assert tasks[-1] >= min(8, len(text) // size)


def test_files_are_kept_apart(spark, tmp_path, ranges):
    rnd = random.Random(4)
    wanted = {f"{k}.json": made_up(rnd, n) for k, n in enumerate((0, 1, 7, 0, 30))}
    for name, rows in wanted.items():
        (tmp_path / name).write_text(json.dumps(rows, indent=1), encoding="utf-8")
    ranges(40)
    rows = arrays.read_array_records(spark, str(tmp_path), positions=True).collect()
    for name, own in wanted.items():
        mine = sorted((r for r in rows if r.position.file.endswith(name)), key=lambda r: r.position)
        assert [(r.pk, json.loads(r.fields)) for r in mine] == [(w["pk"], w["fields"]) for w in own]
    assert len(rows) == 38


def test_the_plain_reader_gives_the_same(spark, tmp_path, ranges):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(made_up(random.Random(8), 50), indent=2), encoding="utf-8")
    ranges(100)
    ours = arrays.read_array_records(spark, str(path)).collect()
    plain = records.read_records(spark, str(path), array_files=True).collect()
    key = lambda r: (r.model, r.pk, json.dumps(json.loads(r.fields)))
    assert sorted(map(key, ours)) == sorted(map(key, plain))


@pytest.mark.parametrize("text", [
    '[{"model": "a", "pk": 1, "fields": {}}', '[{"model": "a"', '[{"model": "a", "pk": 1} x {"model": "a"}]', '{"model": "a"}',
    '[{"model": "a}]', '[{"pk": 1}] [', '[{"pk": 1}{"pk": 2}]', '["x", {"pk": 1}]', "[", "x",
])
def test_what_is_no_array_of_records_stops_the_job(spark, tmp_path, text):
    path = tmp_path / "a.json"
    path.write_text(text)
    with pytest.raises(Exception, match="no array of records|MALFORMED"):
        arrays.read_array_records(spark, str(path)).collect()


def test_empty_arrays_and_files(spark, tmp_path):
    for i, text in enumerate(["[]", " [ ]\n", ""]):
        (tmp_path / f"{i}.json").write_text(text)
    assert arrays.read_array_records(spark, str(tmp_path)).count() == 0


def test_one_file_is_written_and_read_by_many_tasks(spark, tmp_path, ranges):
    rows = spark.range(2000).selectExpr("'a.b' AS model", "id AS pk", """to_json(struct(concat('n', id, '"}{') AS name)) AS fields""")
    path = str(tmp_path / "out")
    arrays.write_array_file(rows.repartition(5), path)
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    tasks = ranges(20_000)
    back = arrays.read_array_records(spark, path)
    assert tasks[0] > 3
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert len(json.load(next((tmp_path / "out").glob("part-*")).open())) == 2000
