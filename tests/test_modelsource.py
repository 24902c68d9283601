"""The data source of model files, and pressed collections."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions.alphabet import AMINO
from seqloom.operators import profile as P
from seqloom.operators import search as R
from seqloom.sources import hmmfile, modelforms
from seqloom.sources import modelsource as M


def some_models(n=23):
    rng = random.Random(4)
    out = []
    for k in range(n):
        m = P.single_sequence(f"m{k}", "".join(rng.choice(AMINO) for _ in range(rng.randint(1, 30))))
        if k % 3 == 0:
            m.acc, m.descr = f"A{k}", "é words"
        if k % 4 == 0:
            m.stats = dict.fromkeys(modelforms.STATS, 0.5)
            m.map = list(range(2, m.m + 2))
        if k % 5 == 0:
            m.checksum, m.max_length, m.rf = 7 + k, 99, "x" * m.m
        if k % 7 == 0:
            m.cutoffs = {"ga": (1.0, 2.0)}
        out.append(m)
    return out


@pytest.fixture(scope="module")
def table(spark):
    M.register(spark)
    return spark.createDataFrame([hmmfile.record(m) for m in some_models()], hmmfile.SCHEMA)


def load(spark, path, **options):
    return spark.read.format("profile_models").options(path=str(path), **options).load()


def close(a, b):
    return a.name == b.name and np.allclose(a.mat, b.mat, atol=1e-4) and np.allclose(a.t, b.t, atol=1e-4) and (a.acc, a.descr, a.consensus, a.map, a.max_length, a.checksum) == (b.acc, b.descr, b.consensus, b.map, b.max_length, b.checksum)


@pytest.mark.parametrize("kind", ["binary", "text"])
@pytest.mark.parametrize("size", ["200", "3000", "10000000"])
def test_models_written_by_tasks_are_read_by_tasks(spark, table, tmp_path, kind, size):
    folder = tmp_path / "models"
    table.repartition(3).write.format("profile_models").options(path=str(folder), kind=kind).mode("append").save()
    (folder / "_other").write_text("left out")
    df = load(spark, folder, partbytes=size)
    found = {r["name"]: hmmfile.from_record(r) for r in df.collect()}
    assert len(found) == df.count() == 23 and all(close(found[m.name], m) for m in some_models())
    assert df.rdd.getNumPartitions() >= (10 if size == "200" else 3)
    places = {(r.file, r.position): r.name for r in df.select("file", "position", "name").collect()}
    (file, position), name = next(iter(places.items()))
    assert [r.name for r in load(spark, file).where(F.col("position") == position).collect()] == [name]


def test_filters_leave_out_partitions(spark, table, tmp_path):
    folder = tmp_path / "models"
    table.coalesce(1).write.format("profile_models").options(path=str(folder)).mode("append").save()
    df = load(spark, folder, partbytes="1")
    assert df.rdd.getNumPartitions() == 23
    one, two, none = df.where("name = 'm5'"), df.where("name IN ('m1', 'm2') AND m > 0"), df.where("name = 'absent'")
    assert (one.rdd.getNumPartitions(), two.rdd.getNumPartitions(), none.rdd.getNumPartitions()) == (1, 2, 1)
    assert [r.name for r in one.collect()] == ["m5"] and sorted(r.name for r in two.collect()) == ["m1", "m2"] and none.count() == 0
    assert df.where("acc = 'A3'").count() == 1


def test_records_of_text_are_cut_anywhere(tmp_path):
    """Every cut of a text file into ranges gives every record once."""
    text = "\n".join(["", "A1", "x // y", "//", "", "B2", "//   ", "C3", "//x", "//"]) + "\n\n"
    path = tmp_path / "t"
    path.write_text(text)
    expected = [(0, "A1\nx // y\n//\n"), (14, "B2\n//   \n"), (24, "C3\n//x\n//\n")]

    def read(low, high):
        with M.opened(str(path))[0].open_input_file(str(path)) as f:
            return list(M.text_records(f, low, high))

    assert read(0, len(text)) == expected
    for cut in range(len(text) + 1):
        assert read(0, cut) + read(cut, len(text)) == expected
    path.write_text("A1\n//\nB2\n")
    with pytest.raises(ValueError, match="cut short"):
        read(0, 9)


def test_headers_say_how_long_records_are(tmp_path):
    path = tmp_path / "b"
    data = [modelforms.to_binary(m) for m in some_models()]
    path.write_bytes(b"".join(data))
    at = 0
    with M.opened(str(path))[0].open_input_file(str(path)) as f:
        for m, d in zip(some_models(), data, strict=True):
            assert M.record_at(f, at) == (m.name, len(d))
            at += len(d)
        with pytest.raises(ValueError, match="3/f"):
            M.record_at(f, 1)
        with pytest.raises(ValueError, match="cut short"):
            M.record_at(f, at - 3)


def test_what_cannot_be_done_is_refused(spark, table, tmp_path):
    with pytest.raises(Exception, match="added to a folder"):
        table.write.format("profile_models").options(path=str(tmp_path / "x")).mode("overwrite").save()
    with pytest.raises(Exception, match="absent"):
        load(spark, tmp_path / "absent").collect()
    (tmp_path / "empty").mkdir()
    assert load(spark, tmp_path / "empty").count() == 0


def test_a_pressed_collection_is_read_in_parts(spark, table, tmp_path):
    path = str(tmp_path / "pressed")
    M.press(table, path)
    first = M.filter_parts(spark, path)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "gains" in plan and "nodes" not in plan and "cutoffs" not in plan
    rows = {r.name: r for r in first.collect()}
    for m in some_models():
        cost, bias = P.quantise_msv(P.configure(m))
        assert np.array_equal(np.frombuffer(rows[m.name].gains, np.uint8).reshape(cost.shape), cost) and rows[m.name].bias == bias
    late = M.rest_of(spark, path, spark.createDataFrame([("m3",), ("m8",), ("m3",), ("absent",)], "name string"))
    assert {r["name"]: close(hmmfile.from_record(r), some_models()[int(r["name"][1:])]) for r in late.collect()} == {"m3": True, "m8": True}
    assert "PushedFilters: [IsNotNull(name), EqualTo(name,m3)]" in spark.read.parquet(path).where("name = 'm3'")._jdf.queryExecution().executedPlan().toString()


def test_models_from_files_search_alike(spark, table, tmp_path):
    folder = tmp_path / "models"
    table.where("m > 8").write.format("profile_models").options(path=str(folder)).mode("append").save()
    seqs = spark.createDataFrame([(k, f"s{k}", m.consensus * 2) for k, m in enumerate(some_models())], "seq_id bigint, name string, seq string")
    models = [hmmfile.from_record(r) for r in load(spark, folder).where("name IN ('m1', 'm2')").collect()]
    direct = [m for m in some_models() if m.name in {x.name for x in models}]
    key = lambda models: sorted((r.model, r.seq_id) for r in R.msv_search(seqs, models).where("rank = 1").collect())
    assert key(models) == key(direct)
