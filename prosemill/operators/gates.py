"""Verdicts by rule over a table of metrics, one row for each run. The thresholds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# The thresholds of all verdicts.


def proceed_rules() -> dict[str, Column]:
    return {"accurate": (c("ba") >= 0.65) & (c("ci_low") > 0.50), "significant": c("perm_p") < 0.01, "rhythm_in_top3": c("rhythm_in_top3"), "beats_baseline": c("margin") >= 0.05, "residual": c("resid_ci_low") > 0.50, "era": c("era_ba") >= 0.60}


def kill_rules() -> dict[str, Column]:
    return {"weak": (c("ba") <= 0.55) | (c("ci_low") <= 0.50), "not_significant": c("perm_p") >= 0.05, "residual_collapses": c("resid_ci_low") <= 0.50, "baseline_does_it": c("best_baseline") >= c("ba")}


def _all(conds) -> Column:
    out = F.lit(True)
    for x in conds:
        out = out & x
    return out


def _any(conds) -> Column:
    return ~_all([~x for x in conds])


def first_gate(metrics: DataFrame, proceed: dict[str, Column] | None = None, kill: dict[str, Column] | None = None) -> DataFrame:
    """metrics with verdict: KILL by any, PROCEED by all, DANGER in between, else NO-GO; and how many of each hold."""
    proceed, kill = proceed or proceed_rules(), kill or kill_rules()
    count = lambda conds: sum((x.cast("int") for x in conds), F.lit(0))
    verdict = F.when(_any(kill.values()), "KILL").when(_all(proceed.values()), "PROCEED").when((c("ba") > 0.55) & (c("ba") < 0.65), "DANGER").otherwise("NO-GO")
    return metrics.withColumns({"proceed_met": count(proceed.values()), "kill_met": count(kill.values()), "verdict": verdict})


def second_gate(metrics: DataFrame) -> DataFrame:
    """Two binding contrasts: the residual one and the plain one."""
    go = (c("resid_ci_low") > 0.50) & (c("resid_p") < 0.01) & (c("ba") >= 0.65) & (c("ci_low") > 0.50) & (c("perm_p") < 0.01)
    kill = (c("resid_ci_low") <= 0.50) | (c("resid_p") >= 0.05) | (c("ba") <= 0.55) | (c("ci_low") <= 0.50) | (c("perm_p") >= 0.05)
    return metrics.withColumn("verdict", F.when(kill, "KILL").when(go, "PROCEED").otherwise("NO-GO"))


def order_gate(metrics: DataFrame, least_increment: float) -> DataFrame:
    """Three primaries: lift over summaries, real over shuffled order, and gain beyond the lexical baseline."""
    m = metrics.withColumns({"primary_1": c("lift_low") > 0, "primary_2": c("shuffled_low") > 0, "primary_3": (c("resid_p") < 0.01) & (c("increment_low") > least_increment)})
    return m.withColumn("verdict", F.when(c("primary_1") & c("primary_2") & c("primary_3"), "PASS").otherwise("KILL"))


def judge_status(metrics: DataFrame, floor: float = 0.60, redundant: float = 0.05) -> DataFrame:
    """What features add beyond a judge, by the interval of the increment."""
    s = F.when(c("ba_judge") < floor, "VOID").when(c("inc_low") > 0, "ADDS").when(c("inc_high") < redundant, "REDUNDANT").otherwise("INCONCLUSIVE")
    return metrics.withColumn("status", s)


def quality_claim(primary: Column, control: Column) -> Column:
    return F.when((primary == "ADDS") & (control != "ADDS"), "adds quality").when(primary == "ADDS", "confounded").otherwise("no clean signal")


def robustness(metrics: DataFrame, least_drop: float = 0.03, ratio: tuple[float, float] = (0.6, 1.6), least_n: int = 140) -> DataFrame:
    """Whether a rewrite was a fair test, and what it says."""
    m = metrics.withColumns({"degraded": c("lexical_drop") > least_drop, "length_ok": c("length_ratio").between(*ratio), "covered": c("n") >= least_n})
    valid = c("degraded") & c("length_ok") & c("covered")
    return m.withColumn("verdict", F.when(~valid, "INVALID").when(c("diff_low") > 0, "SUPPORTED").otherwise("NOT-SUPPORTED"))
