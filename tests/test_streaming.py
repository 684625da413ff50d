"""The stream of file versions gives what the batches give; a batch touches its own buckets, and can be run again."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orrery.operators import changes, index
from orrery.streaming import reindex as rx

SCHEMA = "file_path string, content string, updated_at timestamp"


@pytest.fixture
def versions(spark):
    def make(rows):
        return spark.createDataFrame(rows, "file_path string, content string, u string").select("file_path", "content", F.to_timestamp("u").alias("updated_at"))

    return make


def rows_of(df):
    return sorted(str(r.asDict()) for r in df.collect())


def stamps(root):
    """Path, time and size of each file of the points."""
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(root).rglob("*.parquet") if "points" in p.parts}


def test_stream_equals_batches(spark, tmp_path, versions):
    first = [("/a.py", "def login(token): return token\n", "2024-01-01 00:00:00"), ("/b.py", "from a import login\n", "2024-01-01 00:00:00")]
    second = [("/a.py", "class Query: pass\nselect = insert = table\n" * 9, "2024-01-02 00:00:00"), ("/b.py", "from a import login\n", "2024-01-02 00:00:00")]
    ids = [r["id"] for r in versions(first).select(index.point_id(F.col("file_path")).alias("id")).collect()]
    contracts = spark.createDataFrame([("c1", ids[1], ids[0], "import", 0.1)], "id string, caller_id string, callee_id string, contract_type string, baseline_distance double")
    store, other = rx.Store(spark, str(tmp_path / "store"), 4), rx.Store(spark, str(tmp_path / "other"), 7)
    for number, rows in enumerate((first, second)):
        versions(rows).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        rx.start(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), store, contracts, str(tmp_path / "checkpoint")).awaitTermination()
        other.apply(versions(rows), number, contracts)
    for name in rx.EMPTY:
        assert rows_of(store.read(name)) == rows_of(other.read(name))
    assert store.read("deltas").count() == 1  # /b.py didn't move
    assert store.read("tensions").count() == 1


def test_batches_touch_their_own_buckets_and_can_be_run_again(spark, tmp_path, versions):
    body = "def run(a):\n    return query(a)\n"
    files = [(f"/f{i}.py", body * (i % 5 + 1), "2024-01-01 00:00:00") for i in range(40)]
    store = rx.Store(spark, str(tmp_path), 8)
    ids = [r["id"] for r in versions(files).select(index.point_id(F.col("file_path")).alias("id")).collect()]
    contracts = spark.createDataFrame([(f"c{i}", ids[i], ids[i - 1], "import", 0.5) for i in range(1, 40)], "id string, caller_id string, callee_id string, contract_type string, baseline_distance double")
    store.apply(versions(files), 0, contracts)
    assert store.read("points").count() == 40 and store.read("deltas").count() == 0
    before = stamps(tmp_path)

    changed = [("/f3.py", "class Login:\n    token = password\n" * 20, "2024-01-02 00:00:00"), ("/f4.py", files[4][1], "2024-01-02 00:00:00"), (None, "x", "2024-01-02 00:00:00")]
    changed.insert(0, ("/f3.py", "an earlier version", "2024-01-01 12:00:00"))
    store.apply(versions(changed), 1, contracts)
    after = stamps(tmp_path)
    assert {k: after[k] for k in before} == before  # no file of another bucket or batch changed
    fresh = {Path(k).parent.parent.name for k in after if k not in before}
    touched = store._buckets_of(spark.createDataFrame([(ids[3],)], "id string"))
    assert fresh == {f"bucket={b}" for b in touched}  # /f4.py didn't move
    tables = {n: rows_of(store.read(n)) for n in rx.EMPTY}
    assert len(tables["deltas"]) == 1 and len(tables["points"]) == 40
    assert {(r["delta_id"], r["status"]) for r in store.read("tensions").collect()} == {(store.read("deltas").first()["id"], "detected")}

    store.apply(versions(changed), 1, contracts)  # again: nothing is added or lost
    assert {n: rows_of(store.read(n)) for n in rx.EMPTY} == tables
    assert rows_of(store.read("points", before=1)) != tables["points"]

    present = versions(files).where("file_path <> '/f7.py'")
    before = stamps(tmp_path)
    assert [r["id"] for r in store.prune(present, 2).collect()] == [ids[7]]
    assert {k: v for k, v in stamps(tmp_path).items() if k in before} == before
    assert store.read("points").count() == 39 and store.read("points", before=2).count() == 40
    assert [r["id"] for r in store.prune(present, 3).collect()] == []
    assert store.vacuum() == 0 and store.vacuum(1) == len(touched | store._buckets_of(spark.createDataFrame([(ids[7],)], "id string"))) + (touched == store._buckets_of(spark.createDataFrame([(ids[7],)], "id string")))
    assert store.read("points").count() == 39


def test_a_bucket_of_which_all_points_go(spark, tmp_path, versions):
    store = rx.Store(spark, str(tmp_path), 1)
    none = spark.createDataFrame([], "id string, caller_id string, callee_id string, contract_type string, baseline_distance double")
    store.apply(versions([("/a.py", "x = 1", "2024-01-01 00:00:00")]), 0, none)
    store.prune(versions([]), 1)
    assert store.read("points").count() == 0
    store.apply(versions([]), 2, none)
    assert store.read("points").count() == store.read("deltas").count() == 0


def test_kept_magnitudes_give_the_threshold_of_the_history(spark):
    rng = [0.02 * ((i * 37) % 11 + 1) for i in range(30)]
    rows = [(str(n), str(i), i, m) for n in (1, 2, 3, 20, 30) for i, m in enumerate(rng[:n])]
    history = spark.createDataFrame(rows, "code_point_id string, id string, s int, movement_magnitude double").select("code_point_id", "id", F.timestamp_seconds("s").alias("created_at"), "movement_magnitude")
    want = {r["code_point_id"]: r["threshold"] for r in changes.adaptive_thresholds(history).collect()}
    recent = spark.createDataFrame([(str(n), rng[:n][-20:]) for n in (1, 2, 3, 20, 30)], "id string, recent array<double>")
    got = {r["id"]: r["t"] for r in recent.select("id", rx.threshold(F.col("recent")).alias("t")).collect()}
    assert got == pytest.approx(want)
