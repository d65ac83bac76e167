"""Rules as data: one scan of a table answers them all, and the offending rows are kept."""

from pyspark.sql import functions as F

from petrograph.operators.quality import DOMAINS, RANGES, Rule, checked, entity_rows, offenders, quarantine
from petrograph.plans.inspect import plan_text
from petrograph.plans.storage import scratch_path
from tests.conftest import SF0001


def test_all_rules_in_one_scan_of_events(spark):
    rules = RANGES + DOMAINS
    plan = plan_text(checked(entity_rows(spark, SF0001, rules), rules))
    assert plan.count("events.parquet") == 1 and plan.count("orders.parquet") == 1


def test_counts_and_quarantine_agree(spark):
    rules = (Rule("sentiment", "event", "sentiment", -0.5, 1), Rule("edge_weight", "edge", "weight", 0.1, 0.9),
             Rule("confidence", "prediction", "confidence", 0.01, 1), Rule("factor_impact", "factor", "impact", 0, 0.5),
             Rule("edge_type", "edge", "type", values=("causation",)))
    rows = entity_rows(spark, SF0001, rules)
    counts = {r.check: r.n_violations for r in checked(rows, rules).collect()}
    kept = quarantine(rows, rules, scratch_path(spark, "quarantine-test"))
    found = {r.rule: r.n for r in kept.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).collect()}
    assert {k: n for k, n in counts.items() if n} == found and len(found) >= 4
    assert kept.where(F.size("rules") > 1).count() > 0          # an edge may break both its rules
    assert offenders(rows, RANGES).count() == 0                 # the data keep to the declared ranges
