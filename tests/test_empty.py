"""Queries on tables without rows."""

import pytest

from colloquy.plans.catalog import registry
from test_oracle import TABLES

NAMES = [n for n in registry() if n.split("_")[0] in "o03 o05 o51 o53 o60 o61 o64 o65 o71 o76 o77 o78 o85 o90 o93 o94 o95 o108 o138 o139 o141 o149".split()]


@pytest.fixture(scope="module")
def nothing(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, nothing, name):
    rows = registry()[name][0](spark, nothing).collect()
    assert len(rows) <= 1  # counts of nothing are a row
