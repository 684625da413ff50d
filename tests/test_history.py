"""Commits of a repository as rows."""

import subprocess

import pytest
from pyspark.sql import functions as F

from orrery.functions import temporal
from orrery.sources import history


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=A B", "-c", "user.email=a@b", *args], check=True, capture_output=True)


def test_commits(spark, tmp_path):
    git(tmp_path, "init", "-q")
    for i, day in enumerate(["2024-01-01T10:00:00+05:00", "2024-01-02T10:00:00+05:00"]):
        (tmp_path / "x.py").write_text(f"x = {i}")
        (tmp_path / f"y{i}.py").write_text("y")
        git(tmp_path, "add", ".")
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=a@b", "commit", "-qm", "m", "--date", day], check=True, env={"GIT_COMMITTER_DATE": day, "PATH": "/usr/bin:/bin"})
    rows = history.commits(spark, str(tmp_path)).orderBy("ts", "file_path").collect()
    assert [(r["file_path"].rsplit("/", 1)[1], str(r["ts"]), r["author"]) for r in rows] == [
        ("x.py", "2024-01-01 10:00:00", "A B"),
        ("y0.py", "2024-01-01 10:00:00", "A B"),
        ("x.py", "2024-01-02 10:00:00", "A B"),
        ("y1.py", "2024-01-02 10:00:00", "A B"),
    ]
    assert history.repository_root(str(tmp_path / "sub")) == str(tmp_path)
    f = temporal.features(history.commits(spark, str(tmp_path)), F.to_timestamp(F.lit("2024-01-03 10:00:00")))
    assert {r["file_path"].rsplit("/", 1)[1]: round(r["change_frequency"] * 30) for r in f.collect()} == {"x.py": 2, "y0.py": 1, "y1.py": 1}
    with pytest.raises(history.HistoryError):
        history.commits(spark, str(tmp_path / "nothing"))
    with pytest.raises(history.HistoryError):
        history.commits(spark, str(tmp_path), timeout=0.0)


def test_renames_are_followed(spark, tmp_path):
    git(tmp_path, "init", "-q")
    text = "".join(f"line {i}\n" for i in range(20))

    def commit(**files):
        for name, content in files.items():
            (tmp_path / name).write_text(content)
        git(tmp_path, "add", "-A", ".")
        git(tmp_path, "commit", "-qm", "m")

    commit(a=text)
    commit(a=text + "more\n", ö="other\n" * 9)
    git(tmp_path, "mv", "a", "b")
    commit()
    commit(a="another file with the old name\n")
    git(tmp_path, "mv", "b", "c")
    commit()
    commit(c=text + "most\n")
    by = {}
    for r in history.commits(spark, str(tmp_path), follow=True).collect():
        by[r["file_path"].rsplit("/", 1)[1]] = by.get(r["file_path"].rsplit("/", 1)[1], 0) + 1
    assert by == {"c": 5, "a": 1, "ö": 1}
    assert history.commits(spark, str(tmp_path)).count() == 7


def test_long_chains_of_names(spark):
    rows = [(0, None, "f0")] + [(i, f"f{i - 1}", f"f{i}") for i in range(1, 12)] + [(20, None, "f3"), (21, "f3", "f0"), (22, None, "f0"), (23, None, "x")]
    got = history.followed(spark.createDataFrame(rows, "seq bigint, old_path string, file_path string")).collect()
    assert {r["seq"]: r["now_path"] for r in got} == {**{i: "f11" for i in range(12)}, 20: "f0", 21: "f0", 22: "f0", 23: "x"}
    assert history.followed(spark.createDataFrame([], "seq bigint, old_path string, file_path string")).count() == 0
