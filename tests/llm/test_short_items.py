"""Benchmark items whose question or answer is shorter than a shingle."""

import duckdb

from tests.conftest import SF
from vecspark.llm import QUERIES, decontaminate


def test_short_questions_and_answers(spark):
    """Each length of question and answer from 1 to 6 words, whole inside a longer text."""
    name = lambda kind, q, a, n: " ".join(f"{kind}{q}x{a}y{k}" for k in range(n))
    items = [(10 * q + a, f"{name('q', q, a, q)}. {name('a', q, a, a)}.") for q in range(1, 7) for a in range(1, 7)]
    fill = " ".join(f"filler{k}" for k in range(100))
    docs = spark.createDataFrame([(i, f"{fill} {t} {fill}") for i, t in items] + [(0, fill)], "doc_id long, text string")
    found = decontaminate.indexes(spark.createDataFrame(items, "item_id long, text string"))
    got = decontaminate.contaminations(docs, found).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i, _ in items]
    assert all(r.question_overlap == r.answer_overlap == 1 for r in got)
    assert [r.doc_id for r in decontaminate.without_contaminated(docs, found).collect()] == [0]


def test_leaks_in_the_larger_table(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op4_decontaminate"](spark, sf).collect()}
    assert (6546, 19) in want and want <= set(got)
    assert all(got[p].question_overlap == got[p].answer_overlap == 1 for p in want)
    assert all(0.8 <= min(got[p].question_overlap, got[p].answer_overlap) for p in set(got) - want)
