"""Co-change, shotgun surgery and top clone pairs against plain Python."""

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from orrery.operators import clones, cochange


def test_pairs_and_shotgun_surgery(spark):
    sets = {i: [f"/f{j}.py" for j in range(8) if (i * 7 + j * j) % 5 < 2 + (j == 0) * 3] for i in range(30)}
    rows = [(p, i, "a") for i, files in sets.items() for p in files] + [("/f0.py", 0, "a"), (None, 1, "a"), ("/f1.py", None, "a")]
    found = cochange.pairs(spark.createDataFrame(rows, "file_path string, n int, author string"), ["n", "author"], support=4)
    changes = Counter(p for files in sets.values() for p in files)
    together = Counter(x for files in sets.values() for x in combinations(sorted(files), 2))
    want = {x: (n, changes[x[0]], changes[x[1]]) for x, n in together.items() if n >= 4}
    assert {(r["file_a"], r["file_b"]): (r["together"], r["changes_a"], r["changes_b"]) for r in found.collect()} == want
    partners = Counter(p for (a, b), (n, na, nb) in want.items() for p, m in ((a, na), (b, nb)) if n / m >= 0.5)
    got = {r["file_path"]: r["partners"] for r in cochange.shotgun_surgery(found, 0.5, 2).collect()}
    assert got == {p: n for p, n in partners.items() if n >= 2}
    assert cochange.pairs(spark.createDataFrame([], "file_path string, n int"), ["n"]).count() == 0


def test_top_pairs_are_the_best_of_all(spark):
    body = [f"def f{i}(a, b):\n    return g{i}(a) + h{i % 3}(b)\n" for i in range(12)]
    files = [(f"/c{i}.py", "".join(body[:9])) for i in range(9)] + [(f"/d{i}.py", "".join(body[i : i + 6])) for i in range(6)] + [("/empty.py", "")]
    df = spark.createDataFrame(files, "file_path string, content string")
    every = [tuple(r) for r in clones.clone_pairs(df).orderBy(F.desc("similarity"), "file_a", "file_b").collect()]
    for k in (1, 5, 36, 40, 1000):
        assert [tuple(r) for r in clones.top_pairs(df, k).orderBy(F.desc("similarity"), "file_a", "file_b").collect()] == every[:k]
