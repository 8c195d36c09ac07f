"""Audit rules, field extraction, lifecycle, workflow and report queries."""
