"""Saved runs: bytes that are as their receipts say, and every kind of change refused."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import runs, timing
from plumbline.sources.receipts import RunError, load_report, load_run, receipts, receipts_of, save_report, save_run

SCHEMA = "id long, choice string, scores array<double>, ok boolean"


@pytest.fixture
def saved(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("ü\n"), F.col("id").cast("string"))).alias("choice"), F.array(F.col("id") / 3, F.lit(-0.5)).alias("scores"), (F.col("id") % 2 == 0).alias("ok"))
    save_run(rows.repartitionByRange(3, "id").sortWithinPartitions("id"), f"file://{tmp_path}/run")
    return tmp_path / "run", rows


def test_round_trip(spark, saved):
    folder, rows = saved
    back = load_run(spark, str(folder), SCHEMA)
    assert sorted(back.collect()) == sorted(rows.collect())
    for r in receipts(spark, str(folder)).collect():
        data = next(folder.glob(f"part-{r.part:05d}-*.jsonl")).read_bytes()
        assert (r.rows, r.bytes, r.sha256) == (data.count(b"\n"), len(data), hashlib.sha256(data).hexdigest())
    with pytest.raises(Exception, match="isn't empty"):
        save_run(rows, str(folder))


@pytest.mark.parametrize("change", ["byte", "cut", "more", "lost", "swapped"])
def test_changed_parts_are_refused(spark, saved, change):
    folder, _ = saved
    one, two = sorted(folder.glob("part-*.jsonl"))[:2]
    data = one.read_bytes()
    if change == "byte":
        one.write_bytes(data.replace(b"0.5", b"0.4", 1))
    elif change == "cut":
        one.write_bytes(data[: data.rindex(b"\n", 0, -1) + 1])
    elif change == "more":
        one.write_bytes(data + data.splitlines(True)[0])
    elif change == "lost":
        one.unlink()
    else:
        other = two.read_bytes()
        two.write_bytes(data), one.write_bytes(other)
    with pytest.raises(Exception, match="isn't as its receipt says|No such file"):
        load_run(spark, str(folder), SCHEMA).count()


def test_changed_manifest_is_refused(saved):
    folder, _ = saved
    path = folder / "manifest.json"
    said = json.loads(path.read_text())
    for change in ({"rows": said["rows"] + 1}, {"bytes": 1}, {"parts": said["parts"][1:]}, {"sha256": "0" * 64}, {"parts": [{**said["parts"][0], "sha256": "1" * 64}, *said["parts"][1:]]}):
        path.write_text(json.dumps(said | change))
        with pytest.raises(RunError):
            receipts_of(folder)


def test_an_interrupted_run_gives_its_whole_parts(spark, tmp_path):
    """A task fails: the parts before it can be used, and nothing is taken for the whole."""
    bad = spark.range(300).repartitionByRange(3, "id").select("id", F.when(F.col("id") == 250, F.raise_error(F.lit("broken off")).cast("string")).otherwise("a").alias("choice"))
    with pytest.raises(Exception, match="broken off"):
        save_run(bad, str(tmp_path / "run"))
    with pytest.raises(Exception, match="isn't finished"):
        load_run(spark, str(tmp_path / "run"), "id long, choice string").count()
    some = {r.id for r in load_run(spark, str(tmp_path / "run"), "id long, choice string", unfinished=True).collect()}
    assert 250 not in some and len(some) in (0, *range(90, 210))


def test_the_prefix_of_a_run(spark, saved):
    """As it stands while its third part is still being written."""
    folder, rows = saved
    (folder / "manifest.json").unlink()
    whole = receipts_of(folder, unfinished=True)
    assert len(whole) == 3
    (folder / "part-00002.receipt.json").unlink()
    some = sorted(r.id for r in load_run(spark, str(folder), SCHEMA, unfinished=True).collect())
    assert some == list(range(whole[0].rows + whole[1].rows))
    (folder / "part-00000.receipt.json").unlink()
    assert load_run(spark, str(folder), SCHEMA, unfinished=True).count() == 0  # no prefix


def test_empty_runs(spark, tmp_path):
    save_run(spark.range(0).select("id"), str(tmp_path / "run"))
    assert load_run(spark, str(tmp_path / "run"), "id long").count() == 0


def test_reports_belong_to_their_run(spark, tmp_path):
    calls = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 2.0), (2, 0, None, 0.5)], "example int, repeat int, choice string, seconds double")
    for name, some in (("one", calls), ("two", calls.where("repeat = 0"))):
        save_report(some, timing.run_summary(some), str(tmp_path / name))
    rows, recorded = load_report(spark, str(tmp_path / "one"), calls.schema)
    assert all(r.agrees for r in runs.verify(recorded, timing.run_summary(rows)).collect())
    assert not all(r.agrees for r in runs.verify(recorded, timing.run_summary(rows.where("repeat = 0"))).collect())
    (tmp_path / "two" / "report.json").write_bytes((tmp_path / "one" / "report.json").read_bytes())
    with pytest.raises(RunError, match="another run"):
        load_report(spark, str(tmp_path / "two"), calls.schema)
