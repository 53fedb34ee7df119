"""Keyed incremental extract, load planning and reconciliation as Spark jobs."""
