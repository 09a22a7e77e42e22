"""Every registered query of the analytics engine against its oracle."""

import pytest
from conftest import SMALL
from oracle import same_rows

from motionspark import catalog

#: Parts of raster_strokes, each of which draws the same 1,620 rasters again; the driver holds them against their oracles too.
PARTS = {"raster_sightings", "raster_lines", "raster_tracks"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - PARTS))
def test_query_matches_oracle(spark, name):
    same_rows(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], SMALL)


def test_every_query_has_an_oracle():
    assert catalog.QUERIES.keys() == catalog.ORACLE_SQL.keys()
