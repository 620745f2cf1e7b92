"""Image-dataset curation, detection post-processing, annotation evaluation and
scan telemetry as Spark jobs."""
