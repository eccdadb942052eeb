"""Streaming.

The registry is published as a monthly full reload, so there is no stream,
watermark, window or state to carry between batches: every job here is a
batch job.  New monthly shards are picked up by the load pipeline
(``firmscope.plans.pipeline``), which rebuilds Gold and the marts as a new
version and swaps the pointer only when the quality gates pass.
"""
