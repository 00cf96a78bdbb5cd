from collections import Counter, defaultdict
from heapq import nlargest

import pytest
from pyspark.sql import functions as F

from entitylake.llm import mixing
from tests.llm.tables import awkward_rows, documents, prose, words


def plain_targets(sizes):
    """Sizes by source to targets, sources above their limit fixed round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        weights = sum(w for s, w in weight.items() if s not in fixed)
        shares = {s: rest * w / weights for s, w in weight.items() if s not in fixed}
        over = [s for s, x in shares.items() if x > 3 * sizes[s]]
        if not over:
            return shares | fixed
        fixed |= {s: 3 * sizes[s] for s in over}


def plain_quotas(votes, seats):
    """Seats by the highest quotient, one at a time."""
    quotients = ((v / (2 * s + 1), -i) for i, (_, v) in enumerate(sorted(votes.items())) if v for s in range(seats))
    names = sorted(votes)
    won = Counter(names[-i] for _, i in nlargest(seats, quotients))
    return {name: won[name] for name in votes}


def rows_of_sources():
    rows = awkward_rows()
    rows += [(1000 + i, prose(i, 5 + i % 90), "en", "hot", 1) for i in range(150)]
    return rows + [(5000, prose(77, 12), "en", "same", 1)] * 60 + [(6000 + i, "one two", None, f"tiny{i}", 1) for i in range(3)]


def mixed(spark, rows, **options):
    df = documents(spark, rows).withColumn("target", F.lit("x")).withColumn("shard", F.lit("y"))
    got = mixing.mix(df, **options).withColumn("taken", mixing.words_taken())
    return got.collect()


@pytest.mark.parametrize("seats", [1, 3, 50, 1000])
def test_apportion_gives_the_highest_quotients(spark, seats):
    groups = {"a": {1: 10.0, 2: 10.0, 3: 10.0, 4: 1.0}, "b": {1: 1000.0, 2: 1.0, 3: 0.0}, "c": {7: 5.0}, "d": {i: 1.0 + i % 7 for i in range(40)}}
    rows = [(g, u, v, seats) for g, votes in groups.items() for u, v in votes.items()]
    df = spark.createDataFrame(rows, "g string, u long, votes double, seats long")
    got = {(r.g, r.u): r.quota for r in mixing.apportion(df, "g", "u").collect()}
    assert got == {(g, u): n for g, votes in groups.items() for u, n in plain_quotas(votes, seats).items()}


@pytest.mark.parametrize("options", [{}, {"block_words": 8, "shard_words": 300}])
def test_laws_of_the_mix(spark, options):
    rows = rows_of_sources()
    got = mixed(spark, rows, **options)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size and all(0 <= s.first < s.after <= r.size for s in r.spans)
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert taken[source] == pytest.approx(target, rel=0.02, abs=12)
    if options:
        assert len({r.shard for r in got if r.source == "hot"}) > 5 and len({r.shard for r in got if r.source == "same"}) > 1


def test_reruns_and_other_partitions_agree(spark):
    rows = rows_of_sources()
    first = Counter((r.doc_id, r.source, r.taken, str(r.spans)) for r in mixed(spark, rows, shard_words=300))
    again = mixing.mix(documents(spark, rows[::-1]).repartition(7), shard_words=300).withColumn("taken", mixing.words_taken())
    assert first == Counter((r.doc_id, r.source, r.taken, str(r.spans)) for r in again.collect())
    other = mixed(spark, rows, shard_words=300, seed=8)
    assert first != Counter((r.doc_id, r.source, r.taken, str(r.spans)) for r in other)


def test_many_equal_rows_are_numbered_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 16)
    rows = rows_of_sources()
    small = Counter((r.doc_id, r.taken) for r in mixed(spark, rows, shard_words=300))
    monkeypatch.undo()
    assert small == Counter((r.doc_id, r.taken) for r in mixed(spark, rows, shard_words=300))


def test_empty(spark):
    assert mixed(spark, []) == []
    only = mixed(spark, [(1, None, None, None, None), (2, "", None, "s", 0)])
    assert [(r.size, r.taken, r.target) for r in only] == [(0, 0, 0.0)] * 2
