"""tabml: supervised learning on tables, expressed as Spark DataFrame / SQL / pyspark.ml jobs.

Layout
------
- ``functions``  column-level expressions (null policy, type classes, date parts, rule columns)
- ``sources``    scans of csv / parquet / builtin tables, dataset catalog, run store
- ``operators``  profile, split, features, metrics, search, training, run analytics
- ``plans``      the stage chain with bounded loop-back, spec checks
- ``streaming``  scoring and live run status on Structured Streaming
"""

from tabml.spec import PipelineConstraints, ProblemSpec

__all__ = ["ProblemSpec", "PipelineConstraints"]
