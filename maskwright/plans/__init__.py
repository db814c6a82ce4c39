"""Whole plans: configuration and the scan, redact, report, restore and evaluation plans."""
