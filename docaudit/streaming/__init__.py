"""Audit events: normalization, status, idempotent consumption, deadlines, verdict reuse, duplicates."""
