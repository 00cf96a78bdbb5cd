import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from entitylake.operators.distinct_states import day_states, distinct_counts


@pytest.mark.parametrize("grain", ["day", "month", "quarter", "year"])
def test_counts_from_day_states_of_two_loads(spark, grain):
    rng = random.Random(4)
    ids = [None, -40_000, 0, 1, 32_768, 32_769, 5_000_000_000, *range(2, 40)]
    rows = [(rng.choice("ab"), date(2023, 11, 1) + timedelta(rng.randint(0, 150)), rng.choice(ids)) for _ in range(800)]
    parts = [spark.createDataFrame(some, "g string, d date, n long") for some in (rows[:300], rows[300:])]
    states = day_states(parts[0], "d", "n", ["g"]).unionByName(day_states(parts[1], "d", "n", ["g"]))
    got = distinct_counts(states, grain, ["g"])
    period = F.date_trunc(grain, "d").cast("date").alias("period")
    want = parts[0].union(parts[1]).where("n IS NOT NULL").groupBy("g", period).agg(F.count_distinct("n").alias("different"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_state_of_few_ids_is_small(spark):
    """Ids far apart have a state each, of a word and not of a bitmap of thousands of ids."""
    df = spark.range(50).select(F.lit(date(2024, 1, 1)).alias("d"), (F.col("id") * 100_000).alias("n"))
    states = day_states(df, "d", "n")
    assert states.count() == 50 and dict(states.dtypes)["ids"] == "bigint"
