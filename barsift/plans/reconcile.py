"""Report tables reconciled with each other, with planted faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from ..operators.identities import Identity, broken
from ..session import staged
from . import sqltext as q
from .registry import query
from .selection import _FP, FOLDS, FTEST, fold_results, popq, six

RULES = [
    Identity("signals_add_up", ("k",), "folds", "signals", "oos_signals", "pooled"),
    Identity("hits_add_up", ("k",), "folds", "precision * signals", "oos_precision * oos_signals", "pooled", 1e-6),
    Identity("folds_counted", ("k",), "folds", "1", "n_folds", "pooled"),
    Identity("one_row_per_fold", ("k", "fold"), "folds", "1", "1"),
]


@query("q05_fold_identities", popq(FOLDS, FTEST, _FP,
       "bad as (select * from fk union all select * from fk where k=10 and fold=3)",
       "bp as (select k, n_folds, oos_signals+(k=3)::int oos_signals, oos_precision from pl)",
       "lf as (select k, sum(signals) s, sum(precision_*signals) h, count(*) n from bad group by 1)",
       """al as (select 'signals_add_up' as "identity", k::varchar as "key", s::double l, oos_signals::double r, 1e-9 t from lf join bp using (k)
  union all select 'hits_add_up', k::varchar, h, oos_precision*oos_signals, 1e-6 from lf join bp using (k)
  union all select 'folds_counted', k::varchar, n, n_folds, 1e-9 from lf join bp using (k)
  union all select 'one_row_per_fold', k||'|'||fold, count(*), 1, 1e-9 from bad group by k, fold)""")
       + f"""select "identity", "key", {q.r6('l')} left_value, {q.r6('r')} right_value from al where abs(l-r)>t""")
def _q05f(spark, folder):
    """Pooled rows against their folds; one fold is doubled and one pooled count raised, which also breaks sums built on them."""
    folds = staged(fold_results(spark, folder))
    pooled = scoring.pool_folds(folds, ["k"])
    doubled = folds.unionByName(folds.filter("k = 10 and fold = 3"))
    raised = pooled.withColumn("oos_signals", F.col("oos_signals") + (F.col("k") == 3).cast("int"))
    return six(broken({"folds": doubled, "pooled": raised}, RULES), "left_value", "right_value")
