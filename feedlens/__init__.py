"""feedlens — three-class text-feedback classification as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a small
family of them); the work runs in Spark, declared with the DataFrame / SQL API
so Catalyst and AQE choose the physical plan.

Subpackages
-----------
functions   column expressions (cleaning, formatting, tokenising, softmax)
sources     readers and writers (CSV, text lines, driver tables, sinks)
operators   relational operators (prepare, split, tokens, models, metrics)
plans       end-to-end jobs and the fixture views the checks run on
streaming   Structured Streaming forms of scoring and the class summary
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
