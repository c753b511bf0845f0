import random

import pytest
from pyspark.sql import functions as F

from folio.functions import quality


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_error_rate(spark):
    cases = [
        ("Ocean falował pod stacją.", "ocean falował pod stacją", 0.0),
        ("Ocean falował pod stacją", "Ocean szumiał pod stacją", 0.25),
        ("Ocean falował", "Ocean falował Ocean falował", 1.0),
        ("Ocean falował", "", 1.0),
        ("", "", 0.0),
        ("", "cokolwiek", 1.0),
        ("Ocean falował pod stacją dziś", "Ocean falował", 0.6),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = [r[0] for r in rows.orderBy("k").select(quality.word_error_rate(F.col("a"), F.col("b"))).collect()]
    assert got == [w for _, _, w in cases]


def test_word_edits_match_dynamic_programming(spark):
    rng = random.Random(1)
    pairs = [([str(rng.randrange(30)) for _ in range(rng.randrange(40))], [str(rng.randrange(30)) for _ in range(rng.randrange(40))]) for _ in range(30)]
    pairs.append(([str(k) for k in range(7000)], [str(k) for k in range(1, 7000)]))
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<string>, b array<string>")
    got = [r[0] for r in rows.orderBy("k").select(quality.word_edits(F.col("a"), F.col("b"))).collect()]
    assert got == [levenshtein(a, b) for a, b in pairs[:-1]] + [1]


@pytest.mark.parametrize("lufs,peak,want", [(-30, -10, 7.0), (-14, -10, -6.0), (-20, -10, 0.0), (-30, -5, 2.0), (-30, -1, -2.0), (-10, -0.5, -10.0), (-60, -40, 12.0), (-91, -91, None)])
def test_gain(spark, lufs, peak, want):
    got = spark.range(1).select(quality.gain_for(F.lit(float(lufs)), F.lit(float(peak)))).first()[0]
    assert got == want if want is None else abs(got - want) < 0.11


def test_samples(spark):
    row = spark.createDataFrame([([0.1, -0.9, 0.5],), ([],)], "s array<float>")
    got = row.select(quality.peak(F.col("s")), quality.is_silent(F.col("s"), 10), quality.apply_gain(F.col("s"), F.lit(6.0))["clipped"], quality.apply_gain(F.col("s"), F.lit(0.01))["clipped"]).collect()
    assert round(got[0][0], 3) == 0.9 and not got[0][1] and got[0][2] == 1 and got[0][3] == 0 and got[1][0] == 0.0 and got[1][1]


def test_words_for_failures(spark):
    rows = spark.createDataFrame([("FileNotFoundError", "x"), ("RuntimeError", "CUDA error"), ("ValueError", "bad")], "k string, m string")
    assert [r[0] for r in rows.select(quality.failure_kind(F.col("k"), F.col("m"))).collect()] == ["voice", "model", "fragment"]
    assert spark.range(1).select(quality.looks_truncated(F.lit(140), F.lit(5.0)), quality.looks_truncated(F.lit(140), F.lit(6.0)), quality.looks_truncated(F.lit(0), F.lit(6.0))).first() == (True, False, False)
