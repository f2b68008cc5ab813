"""All probes and pages reach the operators."""

import pytest

from baitline.plans import inputs as i
from baitline.plans.catalog import QUERIES
from baitline.sources import tables as t


@pytest.mark.parametrize("name", ["dedup_urls", "enrich_threat_intel"])
def test_queries_see_all_variants(spark, folder, name):
    seen = {r.variant % 100 for r in QUERIES[name](spark, folder).select("variant").distinct().collect()}
    assert seen >= set(range(t.N_PROBES)) - ({11} if name == "dedup_urls" else set())


def test_scans_see_all_assessed_variants(spark, folder):
    seen = {r.variant for r in i.scan_log(spark, folder).select("variant").distinct().collect()}
    assert seen == {r.variant for r in i.assessed_probes(spark, folder).select("variant").distinct().collect()}


def test_verdicts_of_every_page(spark, folder):
    asked = t.page_events(spark, folder).select("url").distinct().count()
    assert t.verdicts(spark, folder).select("url").distinct().count() == asked


def test_training_rows_are_rejected_by_scheme(spark, folder, monkeypatch):
    """An http URL in the place of variant 13 stays, as nothing but its scheme ruled it out."""
    changed = t.probe_variants()
    changed[13] = changed[0]
    assert i.training_rows(spark, folder).where("variant = 13").count() == 0
    monkeypatch.setattr(t, "probe_variants", lambda: changed)
    assert i.training_rows(spark, folder).where("variant = 13").count() > 0
