import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from entitylake.llm import common, hmm
from tests.llm.tables import awkward_rows, documents, lower, prose, words


def small_model(states=3, symbols=4, seed=2):
    random = np.random.default_rng(seed)
    rows = lambda *shape: (x := random.random(shape)) / x.sum(axis=-1, keepdims=True)
    return hmm.Model(rows(states), rows(states), rows(states, states), rows(states, symbols).T.copy())


def paths(model, sequence):
    """Probability of every state path of a sequence."""
    states = range(len(model.first))
    for path in itertools.product(states, repeat=len(sequence)):
        p = model.first[path[0]] * model.emits[sequence[0], path[0]]
        for t in range(1, len(sequence)):
            p *= model.moves[path[t - 1], path[t]] * model.emits[sequence[t], path[t]]
        yield path, p


SEQUENCES = [[0], [1, 2, 3, 0], [2, 2], [3, 0, 1, 1, 2]]


def test_likelihood_is_the_sum_over_all_paths():
    model = small_model()
    symbols = np.concatenate(SEQUENCES)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in SEQUENCES])])
    got = hmm.forward_log10(model, model.emits[symbols], bounds)
    assert np.allclose(got, [math.log10(sum(p for _, p in paths(model, s))) for s in SEQUENCES])


def test_expected_counts_are_means_over_all_paths():
    model = small_model()
    want = hmm.Expected.none(3, 4)
    for s in SEQUENCES:
        total = sum(p for _, p in paths(model, s))
        for path, p in paths(model, s):
            want.first[path[0]] += p / total
            for t, state in enumerate(path):
                want.emits[s[t], state] += p / total
                if t:
                    want.moves[path[t - 1], state] += p / total
    got = hmm.Expected.none(3, 4)
    ends = np.cumsum([len(s) for s in SEQUENCES])
    hmm.expect(model, np.concatenate(SEQUENCES), ends - [len(s) for s in SEQUENCES], ends, np.ones(4, dtype=bool), got)
    for name in ("first", "moves", "emits"):
        assert np.allclose(getattr(got, name), getattr(want, name))


@pytest.mark.parametrize("stretch", [1, 2, 7, 64])
def test_stretches_give_the_counts_of_whole_texts(monkeypatch, stretch):
    """Texts cut into stretches against the same texts in one piece, and against sums over all paths."""
    random, model = np.random.default_rng(stretch), small_model(symbols=6)
    lengths = np.array([1, 400, 2, 7, 8, 63, 64, 65, 128, 300])
    symbols, bounds = random.integers(0, 6, lengths.sum()), np.concatenate([[0], np.cumsum(lengths)])
    whole, got = hmm.Expected.none(3, 6), hmm.Expected.none(3, 6)
    hmm.expect(model, symbols, bounds[:-1], bounds[1:], np.ones(10, dtype=bool), whole)
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "GROUP_TOKENS", 100)
    cut = hmm.stretches(hmm._Sequences(symbols, bounds, np.zeros(10, dtype=bool)))
    assert len(cut[0]) > 10
    hmm.expect(model, symbols, *cut, got)
    for name in ("first", "moves", "emits", "log10"):
        assert np.allclose(getattr(got, name), getattr(whole, name))
    assert whole.log10 == pytest.approx(hmm.forward_log10(model, model.emits[symbols], bounds).sum())
    assert whole.moves.sum() == pytest.approx(lengths.sum() - 10) and whole.emits.sum() == pytest.approx(lengths.sum())


def test_stretches_cover_every_training_token(spark):
    """Every token of a training text is in one stretch, and each text begins once."""
    rows = [(i, prose(i, 90 + 40 * i), "en", "s", 1) for i in range(12)]
    blocks = hmm.word_blocks(documents(spark, rows))
    for batch in blocks.toArrow().to_batches():
        for row in range(batch.num_rows):
            sequences = hmm._sequences(batch, row, np.arange(len(batch.column("words")[row])), len(batch.column("words")[row]))
            starts, ends, fresh = hmm.stretches(sequences)
            assert fresh.sum() == (~sequences.held_out).sum()
            assert (ends - starts).sum() == np.diff(sequences.bounds)[~sequences.held_out].sum()


def test_rounds_raise_the_likelihood(spark):
    docs = documents(spark, [(i, prose(i % 7, 60), "en", "s", 1) for i in range(60)])
    blocks = hmm.word_blocks(docs)
    _, seen = hmm.count_words(blocks)
    shares = (seen.held + 0.5) / (seen.tokens + 0.5 * (hmm.CLASSES + 1))
    model, gains = hmm.initial(shares, 3), []
    for _ in range(4):
        model, before = hmm._improved(model, blocks, shares)
        gains.append(before)
    assert gains[-1] > gains[0]


def test_a_round_sums_what_its_blocks_expect_in_full_precision(spark):
    assert hmm.CLASSES >= 1 << 16 and hmm.ROUNDS >= 6
    docs = documents(spark, [(i, prose(i, 60), "en", "s", 1) for i in range(30)]).repartition(3)
    blocks = hmm.word_blocks(docs)
    _, seen = hmm.count_words(blocks)
    shares = (seen.held + 0.5) / (seen.tokens + 0.5 * (hmm.CLASSES + 1))
    before = hmm.initial(shares, 3)
    into = hmm.Expected.none(3, hmm.CLASSES + 1)
    for batch in blocks.select("held_out", "counts", "tokens", "words").toArrow().to_batches():
        for row in range(batch.num_rows):
            classes = hmm._classes_of(batch.column("words")[row].values.to_numpy())
            sequences = hmm._sequences(batch, row, classes, hmm.END)
            hmm.expect(before, sequences.symbols, *hmm.stretches(sequences), into)
    model, log10 = hmm._improved(before, blocks, shares)
    assert log10 == pytest.approx(into.log10, rel=1e-12)
    want = hmm.maximised(into.first + 0.1, into.moves + 0.1, into.emits, shares)
    assert np.allclose(model.emits, want.emits, rtol=1e-11, atol=0)


def hashes_of(some):
    data = [w.encode() for w in some]
    ends = np.cumsum([len(x) for x in data])
    return hmm.span_hashes(np.frombuffer(b"".join(data), dtype=np.uint8), ends - [len(x) for x in data], ends).view(np.int64)


def test_rounds_are_baum_welch_over_single_words(spark):
    """Against plain rounds with a symbol for each word; two words of one class stand in different texts."""
    by_class = {}
    for i, c in enumerate(hmm._classes_of(hashes_of([f"w{i}" for i in range(3000)])).tolist()):
        by_class.setdefault(c, []).append(f"w{i}")
    twins = next(x for x in by_class.values() if len(x) > 1)
    rows = [(i, f"{prose(i % 9, 30)} {twins[i % 2]} {twins[i % 2]}", "en", "s", 1) for i in range(40)]
    docs = documents(spark, rows).repartition(3)
    blocks = hmm.word_blocks(docs)
    counts, seen = hmm.count_words(blocks)
    of_words, sums = hmm.train_words(hmm.stored(hmm.with_counts(blocks, counts)), seen, 3, 2)

    train = [words(lower(r[1])) for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    known = Counter(w for text in train for w in text)
    number = {w: n for n, w in enumerate(known)}
    hashes = hashes_of(known)
    classes = hmm._classes_of(hashes)
    shares = (seen.held + 0.5) / (seen.tokens + 0.5 * (hmm.CLASSES + 1))
    n = np.array(list(known.values()))
    word_shares = np.append(shares[classes] * n / seen.held[classes], shares[hmm.END])
    start = hmm.initial(shares, 3)
    model = hmm.Model(start.first, start.mean, start.moves, np.append(start.emits[classes] * (n / seen.held[classes])[:, None], start.emits[hmm.END :], axis=0))
    symbols = np.concatenate([[*(number[w] for w in text), len(known)] for text in train])
    stops = np.cumsum([len(text) + 1 for text in train])
    for _ in range(2):
        into = hmm.Expected.none(3, len(known) + 1)
        hmm.expect(model, symbols, stops - [len(t) + 1 for t in train], stops, np.ones(len(train), dtype=bool), into)
        model = hmm.maximised(into.first + 0.1, into.moves + 0.1, into.emits, word_shares)
    assert np.allclose(of_words.model.moves, model.moves) and np.allclose(of_words.model.first, model.first)
    assert not np.allclose(*model.emits[[number[w] for w in twins[:2]]], rtol=0.1)
    place = {h: i for i, h in enumerate(hashes.tolist())}
    checked = 0
    for batch in hmm._with_sums(hmm.with_counts(blocks, counts), sums).toArrow().to_batches():
        for row in range(batch.num_rows):
            have, words_of_block, given = hmm._known_words(batch, row)
            got = of_words.emits(words_of_block, have, given)[have > 0]
            assert np.allclose(got, model.emits[[place[h] for h in words_of_block[have > 0].tolist()]], rtol=1e-9)
            checked += len(got)
    assert checked >= len(known)


def test_rounds_leave_one_table_of_blocks_and_one_of_sums(spark, tmp_path, monkeypatch):
    """Superseded tables are empty, so disk does not grow with the rounds, and the scores can still be read."""
    docs = documents(spark, [(i, prose(i % 9, 40), "en", "s", 1) for i in range(40)]).repartition(3)
    folders = (f"file://{tmp_path}/{n}" for n in itertools.count())
    for module in (common, hmm):
        monkeypatch.setattr(module, "shared_folder", lambda _: next(folders))
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    scores = hmm.score_documents(docs, 3, 3)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    rows = Counter()
    for file in tmp_path.rglob("*.parquet"):
        rows[file.relative_to(tmp_path).parts[1]] += pq.ParquetFile(file).metadata.num_rows
    assert sorted(+rows) == ["sums", "table"]
    assert scores.count() == 40


def test_rows_of_a_block_share_its_words(monkeypatch):
    texts = [" ".join(prose(i % 9, 30).split()) for i in range(30)]
    batch = lambda a, z: pa.RecordBatch.from_pydict({"doc_id": list(range(a, z)), "text": texts[a:z], "held_out": [i % 5 == 1 for i in range(a, z)]})
    parts = [hmm._part(batch(a, a + 10)) for a in (0, 10, 20)]
    whole = next(iter(hmm._block(parts)))
    monkeypatch.setattr(hmm, "ROW_TOKENS", 1)
    rows = list(hmm._block(parts))
    assert len(rows) == 3 and [r.column("place")[0].as_py() for r in rows] == [0, 1, 2]
    assert rows[0].column("words") == whole.column("words") and rows[0].column("trained") == whole.column("trained")
    assert all(len(r.column("words")[0]) == 0 for r in rows[1:])
    tokens = np.concatenate([hmm._unpacked(r.column("tokens")[0].as_py()) for r in rows])
    assert np.array_equal(tokens, hmm._unpacked(whole.column("tokens")[0].as_py()))
    spelled = whole.column("words")[0].values.to_numpy()[tokens]
    assert np.array_equal(spelled, hashes_of([w for t in texts for w in words(lower(t))]))
    assert sum((r.column("doc_ids")[0].as_py() for r in rows), []) == list(range(30))


def test_packed_counts_come_back_to_the_bit():
    counts = np.concatenate([np.random.default_rng(1).random(700) ** 9, [0.0, 1e-300, 5e-324, 123456789.125, 1.0]])
    assert np.array_equal(hmm._unpacked_counts(hmm._packed_counts(counts)), counts)
    assert not len(hmm._unpacked_counts(hmm._packed_counts(counts[:0])))


def test_counts_of_a_block_of_very_many_words(spark):
    size = (1 << 23) + 2
    blocks = spark.range(1, numPartitions=1).select(
        F.lit(0).cast("long").alias("block"), F.expr(f"sequence(1L, {size}L)").alias("words"), F.lit(None).alias("trained")
    )
    counts = spark.createDataFrame([(1, 7), (size, 9)], "word long, n long")
    known = F.col("known")
    got = hmm.with_counts(blocks, counts).select(F.size(known), known[0], known[size - 1], F.size(F.filter(known, lambda n: n > 0))).first()
    assert tuple(got) == (size, 7, 9, 2)


def plain(rows):
    tokens = lambda text: [*words(lower(text or "")), "\n"]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows]
    counts = Counter(t for r, h in zip(rows, held) if not h for t in tokens(r[1]))
    total = sum(counts.values())
    for r, h in zip(rows, held):
        w = tokens(r[1])
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (len(counts) + 1))) for t in w)
        yield (r[0], h, len(w), sum(counts[t] > 0 for t in w), total, round(base, 6))


@pytest.fixture(scope="module")
def scored(spark):
    rows = awkward_rows() + [(1000 + i, prose(i, 40 + i), "en", "s", 1) for i in range(40)]
    return rows, hmm.score_documents(documents(spark, rows).withColumn("score", F.lit("x")), rounds=3).collect()


def test_base_counts(scored):
    rows, got = scored
    columns = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert Counter(columns) == Counter(plain(rows))


def test_scores_are_log_probabilities(scored):
    _, got = scored
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_states_learn_what_goes_together(spark):
    """Texts in one of two vocabularies: held-out texts are likelier than under the base."""
    rows = [(i, prose(i, 120) if i % 2 else prose(i, 120).replace("a", "o").replace("e", "u"), "en", "s", 1) for i in range(120)]
    got = [r for r in hmm.score_documents(documents(spark, rows), states=4).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


def test_probabilities_of_all_next_words_add_to_one(spark):
    """Over every known word, the end, and "unknown", for a text of one token before the end."""
    rows = [(i, prose(i, 30), "en", "s", 1) for i in range(30)]
    blocks = hmm.word_blocks(documents(spark, rows))
    counts, seen = hmm.count_words(blocks)
    model = hmm.train(blocks, seen, 3, 1)
    known = {r.word: r.n for r in counts.collect()}
    classes = hmm._classes_of(np.array(list(known), dtype=np.int64))
    share = (1 - seen.unknown[classes]) * np.array(list(known.values())) / seen.held[classes]
    by_state = (model.emits[classes] * share[:, None]).sum(axis=0) + model.emits[hmm.END] + seen.unknown[: hmm.END] @ model.emits[: hmm.END]
    assert np.allclose(by_state, 1)


def test_nothing_to_learn_from(spark):
    assert hmm.score_documents(documents(spark, [])).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = hmm.score_documents(documents(spark, [(held, "a b", "en", "s", 1)])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert row.score == pytest.approx(0)
