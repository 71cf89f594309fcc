"""A cross-section of registered queries against DuckDB; ``check.py`` runs all of them."""

import pytest

from check import DATA, compare, duck
from skyfold.plans import QUERIES, SQL

NAMES = [
    "b7_gps_status", "b10_telemetry_quality", "c9_gps_quality", "c10_nearest_sync", "d5_coverage_buckets", "d10_environment_score", "e2_voxel_downsample",
    "e5_radius_outliers", "f4_dsm_error", "g1_checkpoint_metrics", "h1_voxel_diff", "i3_topology", "i4_face_components", "k2_lexical_rank", "l6_skyline", "l16_alerts",
]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    sf = str(DATA / "sf0.001")
    assert compare(QUERIES[name](spark, sf).toPandas(), duck(sf).execute(SQL[name]).df()) is None


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
