"""Every registered query against its SQL, and the shape of the plans."""

import re

import pytest

import __spark_entry__ as entry
from tools import compare

FOLDER = entry.SMOKE_DIR
TRAINING = {"ml_logreg", "ml_forest", "ml_gbt", "importance_topk", "model_compare", "ml_promise"}
CHECKED = sorted(entry.oracle_sql())


def plan(df):
    """The plan before adaptive execution changes it."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert compare.difference(df, con, entry.oracle_sql()[name]) is None


def test_only_training_lacks_sql():
    lacking = set(entry.queries()) - set(entry.oracle_sql())
    assert {n for n in lacking if n != "pipeline" and not re.match(r"op\d+_", n)} == TRAINING


def test_forest_scores(spark):
    out = entry.queries()["ml_forest"](spark, FOLDER)
    assert out.columns == ["doc_id", "label", "prediction", "probability"]
    assert out.count() > 0 and out.filter("probability < 0 OR probability > 1").count() == 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["ticker", "quarter"] and df.count() > 0


def final_plan(df):
    # The execution has to be the DataFrame's own for its adaptive plan to be final.
    df._jdf.queryExecution().executedPlan().execute().count()
    return re.split(r"== Initial Plan ==", plan(df))[0]


def test_indicators_share_one_shuffle_and_sort(spark):
    """Without hot entities the splitting leaves no trace in the executed plan."""
    from quarterdeck.checks.views import prices
    from quarterdeck.operators.rolling import indicators

    df = indicators(
        prices(spark, FOLDER), "ticker", ["Date", "row_id"], "Close",
        sma=(20, 60), volatility=(20,), momentum=(20,), rsi=(14,),
    )
    text = final_plan(df)
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"\bSort \[", text)) == 1
    assert "Join" not in text and "explode" not in text


def test_asof_calendar_does_not_shuffle_the_left_side(spark):
    text = plan(entry.queries()["asof_backward"](spark, FOLDER))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_scans_read_only_what_is_used(spark):
    text = plan(entry.queries()["rolling_sma"](spark, FOLDER))
    assert "o_orderpriority" not in text
    text = plan(entry.queries()["queue_depth"](spark, FOLDER))
    assert "l_extendedprice" not in text
