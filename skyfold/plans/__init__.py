"""Registered queries over the derived survey tables."""

from importlib import import_module

from skyfold.plans.registry import QUERIES, SQL

FAMILIES = ["q_telemetry", "q_cloud", "q_mesh", "q_frames", "q_fleet", "q_retrieve", "q_accuracy", "q_alignment", "q_scene", "q_sources", "q_placement", "q_surfaces", "q_access", "q_orient", "q_consistency"]
for _name in FAMILIES:
    import_module(f"skyfold.plans.{_name}")

__all__ = ["QUERIES", "SQL"]
