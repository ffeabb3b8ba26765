"""The probabilities that the token loss is taken of."""

from assayforge.plans import sequence_queries
from assayforge.schemas import NOT_SELECTED


def test_only_selected_positions_draw_a_probability(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i + j) % 7}" for j in range(40))) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sequence_queries.scored_targets(spark, str(tmp_path)).collect()
    assert len(got) == 30 * 40 and {r["label"] == NOT_SELECTED for r in got} == {True, False}
    assert all((r["p"] is None) == (r["label"] == NOT_SELECTED) for r in got)
