"""Plan shape checks: pushdown/pruning at the scan, one shuffle for the window stage."""

import re

from fleetrisk.plans.featurize import featured_from_events, hourly_from_events

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_stage_single_shuffle(spark):
    p = _plan(featured_from_events(spark, SF))
    # the rows are shuffled once by (inverter_id, _wchunk); windows and the pandas kernel share it
    wchunk_exchanges = re.findall(r"Exchange hashpartitioning\(inverter_id#\d+, _wchunk#\d+L", p)
    assert len(wchunk_exchanges) == 1, p
    assert "FlatMapGroupsInPandas" in p


def test_hourly_is_hash_aggregate_with_pruned_scan(spark):
    p = _plan(hourly_from_events(spark, SF))
    assert "SortAggregate" not in p and "HashAggregate" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p


def test_no_cartesian_or_nested_loop_joins(spark):
    import __spark_entry__ as E
    qs = E.queries()
    names = ["risk_board", "risk_distribution", "class_weights", "class_ratio", "feature_coverage",
             "serve_complete", "fold_aggregate", "model_performance", "topk_attribution_row",
             "fallback_answers", "walk_forward_folds", "roc_auc", "healthy_baseline"]
    for name in names:
        p = _plan(qs[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
