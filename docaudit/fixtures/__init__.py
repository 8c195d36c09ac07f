"""Audit tables derived from the driver's star-schema tables, and the registered queries."""
