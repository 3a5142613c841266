"""Exact, edited and absent benchmark items; alignment against the cell-by-cell form."""

import random

import numpy as np
import pytest
from llm import brute

from corpus_spark.llm.decontaminate import contaminated_passages, drop_contaminated, smith_waterman


def test_alignment_equals_plain_dynamic_programming():
    rng = np.random.default_rng(4)
    for _ in range(150):
        item, text = rng.integers(0, 5, rng.integers(1, 14)), rng.integers(0, 5, rng.integers(1, 25))
        score, since, until = smith_waterman(item, text)
        assert score == brute.align(item.tolist(), text.tolist())
        if score:
            assert brute.align(item.tolist(), text[since:until].tolist()) == score


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]

    def prose(n):
        return [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]

    items = {i: prose(30) for i in range(12)}
    rows, wanted = [], set()
    for d in range(120):
        w = prose(rng.randrange(20, 200))
        if d % 4 == 0:
            item = rng.randrange(12)
            copy = list(items[item])
            for _ in range(rng.choice([0, 0, 2, 4])):
                copy[rng.randrange(len(copy))] = "edited"
            at = rng.randrange(len(w))
            w[at:at] = copy
            wanted.add((d, item))
        rows.append((d, " ".join(w).capitalize() + "."))
    rows += [(500, None), (501, ""), (502, "the of and the of and"), (503, " ".join(items[0]) + " end"), (503, " ".join(items[0]) + " end")]
    wanted.add((503, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, ""), (92, "zzz")], "item_id long, text string")
    return docs, benchmark, wanted


def test_planted_items_are_found(data):
    docs, benchmark, wanted = data
    rows = contaminated_passages(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == wanted
    assert len(rows) == len(wanted) + 1  # the repeated row is reported twice
    assert all(0.5 <= r.score <= 1 and r.word_from < r.word_to for r in rows)


def test_clean_documents_stay(data):
    docs, benchmark, wanted = data
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in wanted}


def test_a_leak_into_every_document_is_found(spark):
    rng = random.Random(7)
    item = [f"w{rng.randrange(500)}" for _ in range(25)]
    rows = [(i, " ".join([f"x{rng.randrange(900)}" for _ in range(20)] + item)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert contaminated_passages(docs, benchmark).count() == 80


def test_empty_tables(data):
    docs, benchmark, _ = data
    assert contaminated_passages(docs.limit(0), benchmark).count() == 0
    assert contaminated_passages(docs, benchmark.limit(0)).count() == 0
    assert drop_contaminated(docs, benchmark.limit(0)).count() == docs.count()


def test_edited_and_truncated_leaks_into_many_documents_are_found(spark):
    rng = random.Random(8)
    items = [[f"w{i}" for i in range(40)], [f"v{i}" for i in range(40)]]
    edited = ["edited" if i in (5, 14, 23, 32) else w for i, w in enumerate(items[0])]
    prose = [[f"x{rng.randrange(900)}" for _ in range(20)] for _ in range(100)]
    rows = [(i, " ".join(w + (edited if i < 50 else items[1][:26]) + w)) for i, w in enumerate(prose)]
    rows += [(1000 + i, " ".join(w + items[i % 2][:5])) for i, w in enumerate(prose)]  # seeds without an item
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in contaminated_passages(docs, benchmark).collect()}
    assert found == {(i, int(i >= 50)): 0.85 if i < 50 else 0.65 for i in range(100)}
    assert {r.doc_id for r in drop_contaminated(docs, benchmark).collect()} == {1000 + i for i in range(100)}


def test_an_item_stretched_by_inserted_words_is_found(spark):
    item = [f"w{i}" for i in range(40)]
    edited = ["edited" if i in (4, 12, 28, 36) else w for i, w in enumerate(item)]
    inserted = {n: edited[:20] + [f"x{i}" for i in range(n)] + edited[20:] for n in (0, 10, 24, 25, 28, 29, 60)}
    docs = spark.createDataFrame([(n, " ".join(["a", "b"] + w + ["c", "d"])) for n, w in inserted.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in contaminated_passages(docs, benchmark).collect()}
    best = {n: brute.align(item, w) / 80 for n, w in inserted.items()}
    assert got == {n: s for n, s in best.items() if s >= 0.5} and 25 in got and 29 not in got


def test_extra_columns_and_very_long_texts(spark):
    rng = random.Random(9)
    item = [f"w{i}" for i in range(30)]
    words = [f"x{rng.randrange(5000)}" for _ in range(400_000)]
    text = " ".join(words[:300_000] + item + words[300_000:])
    docs = spark.createDataFrame([(1, text, 5, "s"), (2, " ".join(words), 6, "t")], "doc_id long, text string, item_id long, score string")
    benchmark = spark.createDataFrame([(7, " ".join(item), 1)], "item_id long, text string, doc_id long")
    (row,) = contaminated_passages(docs, benchmark).collect()
    assert tuple(row) == (1, 7, 1.0, 300_000, 300_030)
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
