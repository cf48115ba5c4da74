from tubeql import fixtures as fx
from tubeql.queries import QUERIES


def test_all_embeddings_take_part(spark, tmp_path):
    """More than 500 embeddings, of which each is a reference and each is a candidate's feature."""
    d = str(tmp_path)
    vectors = [(i, [float(i), 1.0], i % 10) for i in range(600)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    events = spark.range(1200).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 700 AS int)) AS ts", "id AS user_id", "'error' AS event_type", "1.0D AS value")
    events.write.parquet(f"{d}/events.parquet")
    assert fx.refs(spark, d).select("view_id").distinct().count() == 600
    assert {int(r.feature[0]) for r in fx.cand_feat(spark, d).select("feature").collect()} == set(range(600))
    assert QUERIES["gt_ceiling"](spark, d).count() == 10
