"""Every registered curation query against its SQL."""

from __future__ import annotations

import oracle
import pytest

from gleaner.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    found = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalogue.ORACLES:
        wanted = con.execute(catalogue.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert oracle.normal(found) == oracle.normal(wanted)
    else:
        assert len(found)


def test_whole_tables_are_covered(spark):
    """Every document enters the cache, and mismatches are reported over the whole range of pages."""
    sf = "/root/testdata/sf0.1"
    found = catalogue.QUERIES["cache_upsert_whole"](spark, sf)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert found.count() == documents.select("text").distinct().count() and found.where("gen <> 1").isEmpty()
    pages = {f"h{r.page_id}" for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id").collect()}
    states = {r.name: r.state for r in catalogue.QUERIES["checksum_verify_whole"](spark, sf).collect()}
    assert set(states) <= pages and set(states.values()) == {"missing", "unexpected", "different"}
    assert sum(int(name[1:]) >= 90 for name in states) > len(states) / 2


def test_curated_makes_all_picks(spark, sf_dir):
    rows = catalogue.QUERIES["curated"](spark, sf_dir).toPandas()
    assert sorted(rows["pick"].dropna()) == list(range(1, 101)) or not (rows["reason_code"] == "REDUNDANT").any()
    assert rows["pick"].count() > 8
