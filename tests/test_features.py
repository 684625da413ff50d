"""Feature functions against small expectations in plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from orrery.functions import lexical, semantic, structural
from orrery.functions import vectors as v

TEXTS = [
    "",
    "   \n\t",
    "async def f(x):\n    return getUserName(x)\n",
    "from x import y\nimport React from 'react'\n",
    'if (a++ == b) { go("http://x#y") } // note\n',
    "class A { constructor() { try { this.x = null } catch (error) { throw error } } }\nexport default A;\n",
]


def values(spark, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, content string").select("i", column.alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def python_tokens(text):
    text = re.sub(r"([a-z])([A-Z])", r"\1 \2", text).replace("_", " ").lower()
    return re.findall(r"\b[a-zA-Z]{2,}\b", text)


def test_tokens_and_bigrams(spark):
    assert values(spark, lexical.tokens(F.col("content"))) == [python_tokens(t) for t in TEXTS]
    expected = [[f"{a}_{b}" for a, b in zip(p, p[1:])] for p in map(python_tokens, TEXTS)]
    assert values(spark, lexical.bigrams(lexical.tokens(F.col("content")))) == expected


def test_lexical_is_a_unit_vector_or_zero(spark):
    for x, text in zip(values(spark, lexical.features(F.col("content"))), TEXTS):
        assert len(x) == 65
        n = math.sqrt(sum(a * a for a in x))
        assert n == pytest.approx(0) or n == pytest.approx(1)
        if "return" in text:
            assert x[lexical.VOCABULARY.index("return")] > 0


def test_vocabularies_are_cut_and_filled(spark):
    got = values(spark, lexical.features(F.col("content"), ["return"] * 60, []))
    assert all(len(x) == 65 for x in got)
    assert got[2][:50] == pytest.approx([1 / math.sqrt(50)] * 50)


def test_structural_counts(spark):
    got = values(spark, structural.features(F.col("content")))
    assert all(len(x) == 16 for x in got)
    names = structural.NAMES
    at = lambda i, n: got[i][names.index(n)]
    assert at(0, "loc_normalized") == pytest.approx(1 / 500)
    assert at(2, "num_functions") == pytest.approx(2 / 20)  # async def counts for both patterns
    assert at(3, "num_imports") == pytest.approx(4 / 30)  # `import` twice, `from x import` and `from 'react'` once more
    assert at(0, "halstead_volume") == 0
    assert at(5, "num_classes") == pytest.approx(0.1)
    assert at(4, "comment_ratio") > 0.3  # `//` and `#` inside of a string count too


def test_comments_do_not_change_halstead(spark):
    a = "x = y + 1\n"
    b = "x = y + 1  # a comment with words\n"
    rows = spark.createDataFrame([(a,), (b,)], "content string").select(structural.features(F.col("content")).alias("x")).collect()
    assert rows[0]["x"][8:13] == rows[1]["x"][8:13]


def test_semantic_is_a_distribution(spark):
    got = values(spark, semantic.features(F.col("content")))
    assert all(sum(x) == pytest.approx(1) for x in got)
    assert got[0] == pytest.approx([0.2] * 5)
    custom = {"a": ["react"], "b": ["class"], "c": []}
    other = values(spark, semantic.features(F.col("content"), custom))
    assert other[3] == [1.0, 0.0, 0.0]
    assert values(spark, semantic.dominant_domain(semantic.features(F.col("content")))).count("auth") >= 2


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, 0.0, 2.0])], "a array<double>, z array<double>, w array<double>")
    a, z, w = F.col("a"), F.col("z"), F.col("w")
    got = row.select(v.norm(a), v.cosine_similarity(a, z), v.cosine_distance(a, z), v.euclidean(*v.aligned(a, w)), v.mean(a), v.argmax_name(["x", "y"], a)).first()
    assert list(got) == [5.0, 0.0, 1.0, pytest.approx(math.sqrt(4 + 16 + 4)), 3.5, "y"]
    with pytest.raises(ValueError):
        v.axis_distance({"lexical": a}, {"lexical": a}, "other")
