"""The saved artifact: whole or refused, built once, one writer's for each key."""

import json

import pytest

from waygrid.sinks import artifact


@pytest.fixture
def store(spark, tmp_path):
    return artifact.ArtifactStore(spark, f"file://{tmp_path}/a"), tmp_path / "a"


def tables(spark, n=5):
    return {"edges": spark.range(n).selectExpr("id AS edge_id", "named_struct('a', id, 'b', array(id, null)) AS more"), "names": spark.createDataFrame([(1, "é"), (2, None)], "id long, name string"), "empty": spark.range(0)}


def test_round_trip(spark, store):
    s, _ = store
    want = tables(spark)
    got = s.save("k", want)
    assert got.keys() == want.keys()
    for name in want:
        assert got[name].dtypes == want[name].dtypes and sorted(map(str, got[name].collect())) == sorted(map(str, want[name].collect()))
    assert s.load("k", ["edges"])["edges"].count() == 5
    with pytest.raises(artifact.Refused, match="lacks"):
        s.load("k", ["turns"])
    with pytest.raises(artifact.Refused, match="no artifact"):
        s.load("other")


def rewrite(folder, change):
    path = folder / "pointers/k"
    found = json.loads(path.read_text())
    change(found)
    path.write_text(json.dumps(found))
    crc = path.with_name(".k.crc")
    if crc.exists():
        crc.unlink()


@pytest.mark.parametrize("change, why", [(lambda p: p.update(format="else"), "format"), (lambda p: p.update(version=artifact.VERSION + 1), "version"), (lambda p: p["tables"]["edges"].update(bytes=p["tables"]["edges"]["bytes"] + 8), "cut short")])
def test_refused_and_built_again(spark, store, change, why):
    s, folder = store
    s.save("k", tables(spark))
    rewrite(folder, change)
    with pytest.raises(artifact.Refused, match=why):
        s.load("k")
    built = []
    got = s.load_or_build("k", lambda: built.append(1) or tables(spark, 7))
    assert got["edges"].count() == 7 and built == [1]
    assert s.load_or_build("k", lambda: built.append(2) or tables(spark, 9))["edges"].count() == 7 and built == [1]


def test_a_lost_file_and_a_broken_pointer(spark, store):
    s, folder = store
    s.save("k", tables(spark))
    next((folder / "data").glob("*/names/part-*.parquet")).unlink()
    with pytest.raises(artifact.Refused, match="cut short: names"):
        s.load("k")
    (folder / "pointers/k").write_text("{")
    (folder / "pointers/.k.crc").unlink(missing_ok=True)
    with pytest.raises(artifact.Refused, match="JSON"):
        s.load("k")
    assert s.load_or_build("k", lambda: tables(spark, 3))["edges"].count() == 3


def test_the_first_writer_counts(spark, store):
    s, folder = store
    s.save("k", tables(spark, 5))
    assert s.save("k", tables(spark, 6))["edges"].count() == 5
    # A writer that died before its commit leaves nothing that can be read.
    (folder / "data/half/edges").mkdir(parents=True)
    (folder / "data/half/edges/part-0.parquet").write_bytes(b"half")
    assert s.load("k")["edges"].count() == 5 and not list((folder / "staging").glob("[0-9a-f]*"))


def test_keys_follow_the_inputs(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    one = artifact.inputs_key(spark, [f"{tmp_path}/in"], 1)
    assert one == artifact.inputs_key(spark, [f"{tmp_path}/in"], 1) != artifact.inputs_key(spark, [f"{tmp_path}/in"], 2)
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/in")
    assert artifact.inputs_key(spark, [f"{tmp_path}/in"], 1) != one
