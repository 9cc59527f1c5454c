"""Spec-driven chart tables, recommendations and dashboards."""
