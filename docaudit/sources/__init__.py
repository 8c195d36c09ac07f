"""Readers, stored-table writers and static reference tables."""
