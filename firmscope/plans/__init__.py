"""Jobs that chain operators: load pipeline, mart rebuild, table store and the
query catalogue."""
