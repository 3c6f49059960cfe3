"""The model search leaves out no fold of its plan, and no rate, label or kind of model of its presets."""

import pytest

from barsift import plans
from barsift.operators import models


class _Seen(Exception):
    pass


def test_the_search_visits_every_fold_and_preset(spark, monkeypatch):
    seen = []

    def caught(rows, plan, configs, folds):
        seen.append((plan, configs, folds))
        raise _Seen

    monkeypatch.setattr(models, "search", caught)
    with pytest.raises(_Seen):
        plans.load()["m05_search"](spark, "/root/testdata/sf0.001")
    plan, configs, folds = seen[0]
    assert set(folds) == {r.fold for r in plan.select("fold").distinct().collect()} and len(folds) > 2
    assert {c.target_rate for c in configs} >= set(models.PRESETS["rate"])
    assert {c.label for c in configs} == {"label_high", "label_close"} and {c.model for c in configs} == {"gbt", "rf", "logistic"}
    assert not any(c.settings for c in configs) and len({c.name for c in configs}) == len(configs)
