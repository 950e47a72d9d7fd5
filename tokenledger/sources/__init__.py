"""Readers: log files, thread tables and rate catalogs as DataFrames."""
