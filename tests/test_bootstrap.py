from unittest import mock

from pathloom.operators import stats
from pathloom.plans import event_queries


def test_the_interval_is_taken_from_a_thousand_draws(spark, tmp_path):
    spark.range(400).selectExpr("id % 40 user_id", "cast(id % 17 as double) value").write.parquet(str(tmp_path / "events.parquet"))
    with mock.patch.object(stats, "bootstrap_mean", wraps=stats.bootstrap_mean) as drawn:
        row = event_queries.bootstrap_ci_user_1000(spark, str(tmp_path)).first()
    assert drawn.call_args.args[3] >= 1000 and row.n_units == 40 and row.ci_low < row.mean < row.ci_high
