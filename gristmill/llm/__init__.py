"""Operators for preparing training text: packing, dedup, scoring, scans."""
