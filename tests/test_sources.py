import os

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from tallygrad.functions.random import uniform
from tallygrad.network import NetworkConfig, initial_weights
from tallygrad.plans.training import LOG_SCHEMA
from tallygrad.session import shared_dir, shared_path
from tallygrad.sources.meters import read_meter_csv
from tallygrad.sources.results import append_log, append_predictions, dump_samples, load_weights, read_runs, save_weights
from tallygrad.sources.samples import SampleStore, read_sample_text, sample_text
from tallygrad.sources.synthetic import synthetic_samples

STORE = "id string, month int, j int, label double, features array<double>"


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def test_meter_files_take_their_month_from_the_name(spark, tmp_path):
    jan = write(tmp_path / "201201.csv", "id,barCode,date,total,fee1,fee2\na,x,2012/1/1,1.5,2,\na,x,2012/1/2,oops,3,4\n")
    # Another column order and a column of no interest.
    feb = write(tmp_path / "201202.csv", "fee2,id,note,date,barCode,fee1,total\n9,b,hi,2012/2/1,y,8,7\n")
    rows = {(r.id, r.date): r for r in read_meter_csv(spark, [jan, feb], one_header=False).collect()}
    assert rows["a", "2012/1/1"].asDict() == {
        "id": "a", "bar_code": "x", "date": "2012/1/1", "total": 1.5, "fee1": 2.0, "fee2": None, "month": 201201,
    }
    assert rows["a", "2012/1/2"].total is None
    b = rows["b", "2012/2/1"]
    assert (b.month, b.total, b.fee1, b.fee2, b.bar_code) == (201202, 7, 8, 9, "y")


def test_meter_files_take_their_month_from_the_position(spark, tmp_path):
    one = write(tmp_path / "first.csv", "id,barCode,date,total,fee1,fee2\na,x,d,1,1,1\n")
    two = write(tmp_path / "second.csv", "id,barCode,date,total,fee1,fee2\na,x,d,2,2,2\n")
    rows = read_meter_csv(spark, [one, two], months=[201205, 201206]).collect()
    assert {(r.month, r.total) for r in rows} == {(201205, 1.0), (201206, 2.0)}
    with pytest.raises(ValueError):
        read_meter_csv(spark, [one, two], months=[201205])


def test_any_number_of_months_by_position_is_one_scan(spark, tmp_path):
    paths, months = [], []
    for m in range(12):
        paths.append(write(tmp_path / f"part{m}.csv", f"id,barCode,date,total,fee1,fee2\na,x,d,{m},1,1\n"))
        months.append(201201 + m)
    folder = tmp_path / "part1.csv.d"
    os.makedirs(folder)
    write(folder / "x.csv", "id,barCode,date,total,fee1,fee2\na,x,d,77,1,1\n")
    rows = read_meter_csv(spark, [*paths, str(folder)], months=[*months, 201301])
    assert plan_of(rows).count("FileScan") == 1
    assert {(r.month, r.total) for r in rows.collect()} == {(201201 + m, float(m)) for m in range(12)} | {(201301, 77.0)}


HEADER = "id,barCode,date,total,fee1,fee2\n"


def meter_file(folder, name, total):
    os.makedirs(os.path.dirname(folder / name), exist_ok=True)
    return write(folder / name, f"{HEADER}a,x,d,{total},1,1\n")


def months_read(rows):
    return sorted((r.month, r.total) for r in rows.collect())


def test_months_by_position_hold_for_paths_alike(spark, tmp_path, monkeypatch):
    one, two = meter_file(tmp_path, "a.csv", 1), meter_file(tmp_path, "dir/a.csv", 2)
    assert months_read(read_meter_csv(spark, [one, two], months=[201201, 201202])) == [(201201, 1.0), (201202, 2.0)]
    assert months_read(read_meter_csv(spark, [two, one], months=[201201, 201202])) == [(201201, 2.0), (201202, 1.0)]
    uri = "file://" + one
    assert months_read(read_meter_csv(spark, [uri, two], months=[201201, 201202])) == [(201201, 1.0), (201202, 2.0)]


def test_months_by_position_of_odd_names(spark, tmp_path):
    names = ["with space.csv", "50%25 off.csv", "100%.csv", "a+b#c.csv", "é.csv", "d ir/x.csv"]
    paths = [meter_file(tmp_path, name, i) for i, name in enumerate(names)]
    months = [201201 + i for i in range(len(names))]
    rows = read_meter_csv(spark, paths, months=months)
    assert plan_of(rows).count("FileScan") == 1 and "BroadcastHashJoin" in plan_of(rows)
    assert months_read(rows) == [(m, float(i)) for i, m in enumerate(months)]


def test_months_by_position_of_patterns_and_folders(spark, tmp_path):
    for k in range(3):
        meter_file(tmp_path, f"jan/part{k}.csv", k)
        meter_file(tmp_path, f"feb{k}.csv", 10 + k)
        meter_file(tmp_path, f"mar/day={k}/part.csv", 20 + k)
    paths = [f"{tmp_path}/jan", f"{tmp_path}/feb?.csv", f"{tmp_path}/mar/*"]
    rows = read_meter_csv(spark, paths, months=[201201, 201202, 201203])
    want = [(201201 + i, float(10 * i + k)) for i in range(3) for k in range(3)]
    assert months_read(rows) == want


def test_a_file_with_two_months_is_an_error(spark, tmp_path):
    one = meter_file(tmp_path, "jan/a.csv", 1)
    other = meter_file(tmp_path, "feb.csv", 1)
    for paths in ([one, f"{tmp_path}/jan"], [one, f"{tmp_path}/jan/*"], [one, one, other]):
        with pytest.raises(ValueError, match="several months"):
            read_meter_csv(spark, paths, months=[201201 + i for i in range(len(paths))])
    assert read_meter_csv(spark, [one, f"{tmp_path}/jan"], months=[201201, 201201]).select("month").distinct().count() == 1


def test_a_thousand_months_by_position(spark, tmp_path):
    paths = [meter_file(tmp_path, f"m{i}.csv", i) for i in range(1000)]
    rows = read_meter_csv(spark, paths, months=[190001 + i for i in range(1000)])
    assert len(plan_of(rows)) < 20_000
    assert rows.where("month <> 190001 + total").count() == 0 and rows.count() == 1000


def test_a_file_without_a_month_is_an_error(spark, tmp_path):
    path = write(tmp_path / "january.csv", "id,barCode,date,total,fee1,fee2\na,x,d,1,2,3\n")
    with pytest.raises(Exception, match="no month"):
        read_meter_csv(spark, [path]).collect()


def test_a_file_with_another_header_inside_a_path_is_refused(spark, tmp_path):
    folder = tmp_path / "201203.csv"
    os.makedirs(folder)
    write(folder / "a.csv", "id,barCode,date,total,fee1,fee2\na,x,d,1,2,3\n")
    write(folder / "b.csv", "id,barCode,date,fee1,total,fee2\na,x,d,1,2,3\n")
    with pytest.raises(Exception):
        read_meter_csv(spark, [str(folder)]).collect()


def test_sample_text(spark, tmp_path):
    path = tmp_path / "texts"
    os.makedirs(path)
    write(path / "m1", "0.5,1,2,3,4,5,6,\r\n1.0,1,2,3,4,5,6,\r\n0.1,1,2,\r\n-2,1,2,3,4,5,6\r\n")
    got = read_sample_text(spark, str(path)).orderBy("label").collect()
    assert [(r.id, r.label, r.features) for r in got] == [
        ("m1", -2.0, [1, 2, 3, 4, 5, 6]),
        ("m1", 0.5, [1, 2, 3, 4, 5, 6]),
    ]
    assert read_sample_text(spark, str(path), max_label=None).count() == 3
    assert read_sample_text(spark, str(tmp_path / "nothing")).count() == 0


def test_sample_text_with_bad_numbers(spark, tmp_path):
    path = write(tmp_path / "m2", "0.5,1,2,x,4,5,6,\n0.25,1,2,3,4,5,6,\n")
    with pytest.raises(Exception):
        read_sample_text(spark, path).collect()
    assert [r.label for r in read_sample_text(spark, path, strict=False).collect()] == [0.25]


def test_sample_text_round_trip(spark):
    df = spark.createDataFrame([("a", 0.125, [1.0, 2.5, -3.0, 1e-7, 5.0, 6.0])], "id string, label double, features array<double>")
    path = shared_path(spark, "text")
    sample_text(df).write.text(path)
    back = read_sample_text(spark, path).first()
    assert (back.label, back.features) == (0.125, [1.0, 2.5, -3.0, 1e-7, 5.0, 6.0])


def samples(spark, *rows):
    return spark.createDataFrame([(i, 201201, j, v, [v] * 6) for i, j, v in rows], STORE)


def content(df):
    return sorted((r.id, r.j, r.label) for r in df.collect())


def test_store_replaces_meters_and_keeps_others(spark):
    store = SampleStore(spark, shared_path(spark, "store"), buckets=2)
    assert store.read().count() == 0
    store.save(samples(spark, ("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.3), ("c", 1, 2.0)))
    store.save(samples(spark, ("a", 1, 0.9)))
    assert content(store.read()) == [("a", 1, 0.9), ("b", 1, 0.3), ("c", 1, 2.0)]
    assert content(store.read("a")) == [("a", 1, 0.9)]
    assert content(store.read(["b", "x"])) == [("b", 1, 0.3)]
    wanted = spark.createDataFrame([("b",), ("c",)], "id string")
    assert content(store.read(wanted, max_label=1.0)) == [("b", 1, 0.3)]
    with pytest.raises(ValueError):
        SampleStore(spark, store.path, buckets=3).read()


def test_store_reads_only_the_folders_of_listed_meters(spark):
    store = SampleStore(spark, shared_path(spark, "store"), buckets=8)
    store.save(samples(spark, *[(f"m{k}", 1, 0.1) for k in range(40)]))
    every = set(store.read().inputFiles())
    for wanted in (["m1"], spark.createDataFrame([("m1",)], "id string")):
        scanned = store.read(wanted)
        assert content(scanned) == [("m1", 1, 0.1)]
        files = [f for f in scanned.inputFiles() if store.path in f]
        assert files and {f.split("bucket_of_8=")[1][0] for f in files} == {files[0].split("bucket_of_8=")[1][0]}
        assert set(files) < every


def test_a_write_that_breaks_off_changes_nothing(spark, monkeypatch):
    store = SampleStore(spark, shared_path(spark, "store"), buckets=2)
    store.save(samples(spark, ("a", 1, 0.1), ("b", 1, 0.3), ("c", 1, 2.0)))
    before = content(store.read())

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lost)
        with pytest.raises(RuntimeError):
            store.save(samples(spark, ("a", 1, 0.9)))
    assert content(store.read()) == before
    store.save(samples(spark, ("a", 1, 0.9)))
    assert content(store.read()) == [("a", 1, 0.9), ("b", 1, 0.3), ("c", 1, 2.0)]
    store.vacuum()
    assert content(store.read()) == [("a", 1, 0.9), ("b", 1, 0.3), ("c", 1, 2.0)]


def test_two_writers_at_once(spark, monkeypatch):
    """The second one starts again from what the first has stored; a meter stored by both is stored once."""
    store, other = (SampleStore(spark, shared_path(spark, "unused"), buckets=2) for _ in range(2))
    other.path = store.path
    store.save(samples(spark, ("z", 1, 0.5)))
    write, done = store._write, []

    def late(rows):
        if not done:
            done.append(True)
            other.save(samples(spark, ("a", 1, 0.2), ("b", 1, 0.4)))
        return write(rows)

    monkeypatch.setattr(store, "_write", late)
    store.save(samples(spark, ("a", 1, 0.9)))
    assert content(store.read()) == [("a", 1, 0.9), ("b", 1, 0.4), ("z", 1, 0.5)]


def test_read_through(spark):
    store = SampleStore(spark, shared_path(spark, "store"), buckets=2)
    asked = []

    def build(missing):
        asked.append(sorted(r.id for r in missing.collect()))
        made = missing.select("id").withColumn("v", F.lit(0.5))
        return made.select(
            "id", F.lit(201201).alias("month"), F.lit(1).alias("j"), F.col("v").alias("label"),
            F.array(*[F.col("v")] * 6).alias("features"),
        )

    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    more = spark.createDataFrame([("b",), ("c",), ("c",)], "id string")
    assert content(store.get_or_build(ids, build)) == [("a", 1, 0.5), ("b", 1, 0.5)]
    assert content(store.get_or_build(more, build)) == [("b", 1, 0.5), ("c", 1, 0.5)]
    assert asked == [["a", "b"], ["c"]]
    assert store.read().count() == 3
    assert store.get_or_build(ids, build, max_label=0.5).count() == 0


@pytest.mark.parametrize("path", ["s3a://bucket/store", "gs://bucket/x", "S3://b/y"])
def test_stores_on_object_stores_are_refused(spark, path):
    with pytest.raises(ValueError, match="rename"):
        SampleStore(spark, path)


def test_result_tables(spark):
    scored = spark.createDataFrame([(2.0, 1.5), (0.0, 1.0), (-2.0, -1.0)], "label double, predict_label double")
    path = shared_path(spark, "predictions")
    append_predictions(scored, path)
    append_predictions(scored, path)
    rows = spark.read.parquet(path).distinct().collect()
    assert {(r.label, r.prediction, r.rel_error) for r in rows} == {(2.0, 1.5, 0.25), (0.0, 1.0, None), (-2.0, -1.0, -0.5)}
    assert spark.read.parquet(path).count() == 6

    log = spark.createDataFrame([(1, 5, 0.5, None), (2, 9, 0.4, None)], LOG_SCHEMA)
    path = shared_path(spark, "log")
    append_log(log, path, F.lit("r1"))
    append_log(log, path, F.lit("r2"))
    assert spark.read.parquet(path).groupBy("run").count().count() == 2

    path = shared_path(spark, "dump")
    dump_samples(samples(spark, ("a", 1, 0.5)), path, 6, ["id"])
    assert spark.read.option("sep", "\t").option("header", True).csv(path).columns == ["id", "label"] + [f"x{i}" for i in range(6)]


def test_a_run_that_is_written_again_replaces_its_rows(spark):
    scored = spark.createDataFrame([(2.0, 1.5), (0.0, 1.0)], "label double, predict_label double")
    path = shared_path(spark, "predictions")
    for run in ("7", "b", "7"):
        append_predictions(scored, path, run=run)
    kinds = "label double, prediction double, rel_error double"
    rows = read_runs(spark, path, kinds)
    assert {r.run: r["count"] for r in rows.groupBy("run").count().collect()} == {"7": 2, "b": 2}
    append_predictions(scored.where("label > 0"), path, run="b")
    assert read_runs(spark, path, kinds).where("run = 'b'").count() == 1
    append_predictions(scored.where("label > 9"), path, run="b")
    assert [r.run for r in read_runs(spark, path, kinds).select("run").distinct().collect()] == ["7"]
    broken = scored.select("label", F.raise_error(F.lit("broken")).cast("double").alias("predict_label"))
    with pytest.raises(Exception, match="broken"):
        append_predictions(broken, path, run="7")
    assert read_runs(spark, path, kinds).count() == 2
    log = spark.createDataFrame([(1, 5, 0.5, None), (2, 9, 0.4, None)], LOG_SCHEMA)
    path = shared_path(spark, "log")
    for run in ("x", "y", "x"):
        append_log(log, path, run)
    assert read_runs(spark, path, LOG_SCHEMA).count() == 4
    for wrong in ("", "a/b", "..\n"):
        with pytest.raises(ValueError):
            append_log(log, path, wrong)


def test_weights_round_trip(spark):
    config = NetworkConfig(size=(3, 4, 2, 1))
    weights = initial_weights(config, 5)
    path = shared_path(spark, "weights")
    save_weights(spark, weights, path)
    assert all((a == b).all() for a, b in zip(weights, load_weights(spark, path, config)))
    with pytest.raises(Exception):
        load_weights(spark, path, NetworkConfig(size=(3, 4, 3, 1)))


def test_synthetic_samples(spark):
    for surface in ("sphere", "rastrigin", "rosenbrock"):
        rows = synthetic_samples(spark, 500, 3, -2.0, 2.0, surface, seed=1)
        assert rows.filter(F.exists("features", lambda v: (v < -2) | (v >= 2))).count() == 0
        assert sorted(map(str, rows.collect())) == sorted(map(str, rows.repartition(5).collect()))
    bits = synthetic_samples(spark, 1000, 3, 0, 1, "xor", seed=1).collect()
    assert all(r.label == float(r.features[0] != r.features[1]) for r in bits)
    assert 350 < sum(r.label for r in bits) < 650
    with pytest.raises(ValueError):
        synthetic_samples(spark, 10, 3, 0, 1, "cube")


def test_uniform_draws(spark):
    u = spark.range(20000).select(uniform(F.col("id"), seed=1).alias("a"), uniform(F.col("id"), seed=2).alias("b"))
    r = u.agg(F.avg("a"), F.var_pop("a"), F.corr("a", "b"), F.min("a"), F.max("a")).first()
    assert abs(r[0] - 0.5) < 0.01 and abs(r[1] - 1 / 12) < 0.002 and abs(r[2]) < 0.03
    assert 0 <= r[3] and r[4] < 1


def test_shared_folder(spark):
    assert shared_path(spark, "x").startswith(shared_dir(spark))
    assert shared_path(spark, "x") != shared_path(spark, "x")
