"""rigflow: asset-operations analytics as Spark DataFrame jobs.

Sub-packages:
  sources    reading tables (declared schemas, driver-table adapters), loads and sinks
  functions  Column builders: live statuses, date arithmetic, field checks
  operators  DataFrame -> DataFrame operators (filters, enrichment joins, reports,
             paging/top-k, hierarchy, change application, quality, workflow)
  plans      composed reports (dashboard), query catalog, SQL oracle text
  streaming  Structured Streaming forms of the change / quota jobs
"""

__version__ = "0.1.0"
