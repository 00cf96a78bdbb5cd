from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from entitylake.llm import pieces
from tests.llm.tables import awkward_rows, bag, documents, prose


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.vocabulary_file())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_file())


def best_score(library, word):
    """Best total over all segmentations of a word, an unknown character costing more than any piece."""
    scores = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size())
              if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))}
    unknown = min(scores.values()) - pieces.UNKNOWN_COST

    @cache
    def best(end):
        if not end:
            return 0.0
        found = [best(i) + scores[word[i:end]] for i in range(max(0, end - 20), end) if word[i:end] in scores]
        return max(found) if word[end - 1] in scores else max([*found, best(end - 1) + unknown])

    return best(len(word))


WORDS = sorted({w for seed in range(3) for w in prose(seed, 60).split()} | {"the", "naïve", "a\nb", "漢x漢", "🎈", "xxxxxxx", "été", "I'm"})


def test_paths_are_the_best_of_all_segmentations(vocabulary, library):
    for word in WORDS:
        marked = pieces.MARK + word
        chars = np.array([[ord(c) for c in marked]], dtype=np.uint64)
        ids, counts = vocabulary._paths(chars)
        assert counts.tolist() == [len(ids)]
        unknown = vocabulary.unknown
        total = sum(unknown if i < 0 else library.get_score(int(i)) for i in ids.tolist())
        assert total == pytest.approx(best_score(library, marked))
        assert "".join(chr(-1 - i) if i < 0 else library.id_to_piece(int(i)) for i in ids.tolist()) == marked


def test_the_library_decodes_the_ids(vocabulary, library):
    texts = [prose(3, 40), "naïve ÀÉ ß 漢字 🎈 end", "two  spaces   and\ttab", "line\n\nline"]
    ids, bounds = pieces._encoded(vocabulary, pa.array(texts))
    for k, text in enumerate(texts):
        assert library.decode(ids[bounds[k] : bounds[k + 1]].tolist()) == text


def test_round_trip_of_awkward_rows(spark):
    docs = documents(spark).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    for coded in (pieces.encode_and_decode(docs), pieces.decode(pieces.encode(docs))):
        rows = coded.select("doc_id", "text", "decoded", "ids").collect()
        assert bag((r.doc_id, r.decoded) for r in rows) == bag((i, t) for i, t, *_ in awkward_rows())
        assert all((r.ids is None) == (r.text is None) for r in rows)
        assert all(r.ids == [] for r in rows if r.text == "")


def test_marks_and_slices(vocabulary):
    text = "a▁b " + "word " * 10
    ids, bounds = pieces._encoded(vocabulary, pa.array([text, None, "x"]).slice(0, 3))
    assert vocabulary.decode(ids, bounds) == [text.replace("▁", " "), "", "x"]
    again, _ = pieces._encoded(vocabulary, pa.array(["zzz", text]).slice(1, 1))
    assert again.tolist() == ids[: bounds[1]].tolist()


def test_empty(spark):
    assert pieces.encode_and_decode(documents(spark, [])).collect() == []
