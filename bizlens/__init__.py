"""bizlens: company-registry analytics as Spark DataFrame operators.

Layout:
  functions/  Column -> Column expressions (cleaning, question parsing)
  sources/    readers and writers (CSV extracts, API pages, GeoJSON, dims)
  operators/  DataFrame -> DataFrame operators (dedup, joins, aggregates)
  plans/      composite queries and batch pipelines built from operators
  streaming/  Structured Streaming upkeep of the monthly rollups
"""

from bizlens.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
