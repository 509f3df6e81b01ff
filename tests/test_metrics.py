import pytest

from rfmspark.operators import evaluate as ev

PUBLISHED = {  # (TP, FP, FN, TN) -> accuracy, mcc
    "logistic_regression": ((202, 58, 131, 181), 0.6696, 0.3605),
    "random_forest": ((213, 72, 120, 167), 0.6643, 0.3338),
    "baseline_majority": ((333, 239, 0, 0), 0.5822, 0.0),
}


def scored(spark, tp, fp, fn, tn, score=None):
    rows = [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn
    return spark.createDataFrame([(y, p, score if score is not None else float(p)) for y, p in rows],
                                 "Target int, prediction int, probability double")


@pytest.mark.parametrize("name", list(PUBLISHED))
def test_published_confusion_matrices(spark, name):
    (tp, fp, fn, tn), acc, mcc = PUBLISHED[name]
    m = ev.classification_metrics(scored(spark, tp, fp, fn, tn)).first()
    assert round(m.accuracy, 4) == acc and round(m.mcc, 4) == mcc


def test_constant_score_baseline(spark):  # D13
    s = scored(spark, 333, 239, 0, 0, score=0.58)
    assert ev.roc_auc(s).first().roc_auc == pytest.approx(0.5)
    assert ev.pr_auc(s).first().pr_auc == pytest.approx(0.791083916, abs=1e-9)
    m = ev.classification_metrics(s).first()
    assert m.mcc == 0.0 and m.f1_score == pytest.approx(0.735911602, abs=1e-9)


def test_roc_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "Target int, probability double")
    # pairs: (0.9+,0.9-) tie .5, (0.9+,0.1-) 1, (0.8+,0.9-) 0, (0.8+,0.1-) 1 -> 2.5/4
    assert ev.roc_auc(df).first().roc_auc == pytest.approx(0.625)


@pytest.mark.parametrize("new,old,ok", [(0.54, None, False), (0.60, 0.66, False), (0.62, 0.66, True)])
def test_model_gate(spark, new, old, ok):  # D15
    n = spark.createDataFrame([("m", new)], "model string, roc_auc double")
    o = spark.createDataFrame([("m", old)] if old is not None else [], "model string, roc_auc double")
    assert ev.model_gate(n, o, model="m").first().accepted is ok


def test_leaderboard_first_wins_ties(spark):
    m = spark.createDataFrame([("a", 0, 0.7, 0.8), ("b", 1, 0.8, 0.0), ("c", 2, 0.8, None)],
                              "model string, model_order int, cv_roc_auc_mean double, roc_auc double")
    assert ev.model_leaderboard(m).first().recommended_model == "b"


def test_single_pass_areas_equal_separate_areas(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.5 + 0.3 * y, 2)  # many tied scores
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "Target int, probability double")
    both = ev.curve_areas(df).first()
    assert abs(both.roc_auc - ev.roc_auc(df).first().roc_auc) < 1e-12
    assert abs(both.pr_auc - ev.pr_auc(df).first().pr_auc) < 1e-12
