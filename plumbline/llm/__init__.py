"""Operators of a training-data pipeline: scans, dedup, mixing, extraction, scoring.

Nothing else in the library imports this subpackage.
"""
