"""Go and no-go gates over summary rows: ordered CASE expressions, no data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The preregistered thresholds of the fusion study.
DISCOVERY_GAIN = 0.03
CONFIRMATION_GAIN = 0.02
CONFIRMATION_FRACTION = 0.20
NO_GO_GAIN = 0.01
NO_GO_SHARE = 0.90
COVERAGE = 0.95
#: The thresholds of the budget study.
FULL_GAIN, FRACTION, B_STAR, NO_GO_B_STAR, CONTROL_GAP, RETENTION = 0.02, 0.20, 50, 70, 0.01, 0.98


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(otherwise)
    for condition, label in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), label).otherwise(out)
    return out


def discovery(grids=("w7", "w66")) -> Column:
    """pass if every grid gains enough with an interval above zero."""
    strong = all_of([x for g in grids for x in (F.col(f"{g}_mean_delta") >= DISCOVERY_GAIN, F.col(f"{g}_low") > 0)])
    return first_match([(strong, "pass"), (F.col(f"{grids[0]}_mean_delta") < NO_GO_GAIN, "fail")], "inconclusive")


def confirmation(grids=("w7", "w66")) -> Column:
    strong = all_of([
        x for g in grids for x in (
            F.col(f"discovery_{g}_mean_delta") >= DISCOVERY_GAIN, F.col(f"{g}_mean_delta") >= CONFIRMATION_GAIN,
            F.col(f"{g}_low") > 0, F.col(f"{g}_gain_ge_005") >= CONFIRMATION_FRACTION,
        )
    ])
    g = grids[0]
    weak = (F.col(f"{g}_mean_delta") < NO_GO_GAIN) | (F.coalesce(F.col(f"{g}_top_5pct_share"), F.lit(0.0)) >= NO_GO_SHARE)
    return first_match([(strong, "pass"), (weak, "fail")], "inconclusive")


def budget_confirmation(discovery: str = "discovery", confirmation: str = "confirmation") -> Column:
    """pass if both samples are strong, fail if the confirming one gains too
    little or needs too much, from two struct columns with the fields of a budget
    summary and retention_low. A missing value is inconclusive."""
    def strong(s: str) -> Column:
        x = lambda name: F.col(s)[name]
        return all_of([
            x("full_minus_stage1") >= FULL_GAIN, x("beneficial_fraction") >= FRACTION, x("non_beneficial_fraction") >= FRACTION,
            x("b_star") <= B_STAR, x("control_gap") >= CONTROL_GAP, x("retention_low") >= RETENTION,
        ])

    names = ("full_minus_stage1", "beneficial_fraction", "non_beneficial_fraction", "b_star", "control_gap", "retention_low")
    missing = ~all_of([F.col(s)[n].isNotNull() for s in (discovery, confirmation) for n in names])
    weak = (F.col(confirmation)["full_minus_stage1"] < NO_GO_GAIN) | (F.col(confirmation)["b_star"] > NO_GO_B_STAR)
    return first_match([(missing, "inconclusive"), (strong(discovery) & strong(confirmation), "pass"), (weak, "fail")], "inconclusive")


def final(fusion: str = "fusion_gate", budget: str = "budget_gate") -> Column:
    f, b = F.col(fusion), F.col(budget)
    return first_match([(b == "pass", "budget_aware"), (f == "pass", "page_fusion"), ((b == "fail") & (f == "fail"), "reject_both")], "inconclusive")


def feasibility() -> Column:
    """Status of a short pilot from coverage, mean_delta, low, gain_ge_003 and
    top_5pct_share."""
    ok = all_of([F.col("mean_delta") >= 0.01, F.col("low") > 0, F.col("gain_ge_003") >= 0.10, F.col("top_5pct_share") < NO_GO_SHARE])
    return first_match([(F.col("coverage") < COVERAGE, "invalid_candidate_coverage"), (ok & (F.col("mean_delta") >= DISCOVERY_GAIN), "strong_signal"), (ok, "feasible_signal")], "no_clear_signal")


def outcome(blocked: Column, failed: Column, limited: Column) -> Column:
    """Precedence of a milestone decision."""
    return first_match([(blocked, "BLOCKED"), (failed, "NO-GO"), (limited, "LIMITED")], "GO")


def loss_alignment(rho: str = "rho", gap: str = "gap") -> Column:
    return F.when(all_of([F.col(rho) <= -0.5, F.col(gap) <= 0.01]), "pass").otherwise("fail")


def audit_status() -> Column:
    """Precedence of audit findings."""
    return first_match([(F.col("unresolved_aliases") > 0, "unresolved_aliases"), (F.col("split_overlaps") > 0, "split_overlap"), (F.col("leaks") > 0, "leakage"), (F.col("orphans") > 0, "orphans")], "pass")
