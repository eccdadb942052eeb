"""firmscope — company-registry analytics on Spark.

Layers:

* ``sources``   — raw delimited/zip ingest, lookup loading, CSV export, and the
                  adapter that shapes the driver's test tables into registry tables.
* ``functions`` — pure ``Column`` expressions (cleaning, parsing, labels, bands).
* ``operators`` — DataFrame -> DataFrame operators (gold build, gates, marts,
                  metrics, listing, regional comparison, profiling, segments).
* ``plans``     — jobs that chain operators: load pipeline with write-audit-publish,
                  mart rebuild, table store, and the query catalogue.
* ``streaming`` — intentionally empty (the source is a monthly batch reload).

Every operator takes and returns DataFrames and never collects row data.
"""

__version__ = "0.1.0"
