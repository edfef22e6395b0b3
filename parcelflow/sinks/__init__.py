"""Sinks: CSV, the canonical table, text of KPIs and reports."""
