"""Operators of a training-data pipeline: archives, deduplication, mixing, scoring, tokenising.

Nothing outside this subpackage imports it.  ``catalog.queries()`` lists the
registered queries.
"""
