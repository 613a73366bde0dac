"""hirescope: job-posting analytics as Spark DataFrame jobs.

Layers:
  sources/    schemas, readers, test-table bindings, sinks
  functions/  column expressions (fixed patterns, lists, shares)
  operators/  DataFrame -> DataFrame building blocks
  plans/      the silver and gold models, the keyword snapshot job
  streaming/  incremental upkeep of the latest-posting table
"""

__version__ = "0.1.0"
