"""Skew-safe plan pieces, reports, scheduled jobs, table bindings."""
