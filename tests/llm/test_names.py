"""Operators that return their input's columns leave all of them alone, whatever they are called."""

import pytest
from pyspark.sql import functions as F

from assayforge.llm import line_crf, line_dedup, secrets, simhash

CLASHING = "_id _hash _text_hash _spans _removed _wanted fp root first least h key doc text_hash removed spans good score".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    shared = "\n".join(f"a line of many words that stands in more than one document {i}" for i in range(4))
    rows = [(i, f"own words {i} {i * 7} of this text alone\n{shared}\npassword = hunter2{i}secret", "en", f"s{i}", 10) for i in range(8)]
    rows += [(20, rows[0][1], "en", "s", 1), (21, None, None, None, None), (None, "no id", "en", "s", 1)]
    out = spark.createDataFrame(rows, SCHEMA)
    return out.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).repartition(3)


OPERATORS = {
    "deduplicated": line_dedup.deduplicated,
    "redacted": secrets.redacted,
    "without_near_duplicates": simhash.without_near_duplicates,
    "accepted": lambda df: line_crf.accepted(df, 1.0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_own_columns_stay(docs, name):
    got, plain = OPERATORS[name](docs), OPERATORS[name](docs.drop(*CLASHING))
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    assert sorted(map(str, got.drop(*CLASHING).collect())) == sorted(map(str, plain.collect()))


def test_queries_of_one_id_are_answered_each(spark):
    from assayforge.llm import topk

    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.5, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20, k=2).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 1, 4096), (20, 1, 2, 4096), (20, 2, 2, 2048), (20, 2, 20, 4096)]
