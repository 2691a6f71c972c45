"""Change-data pipelines as Spark jobs: bronze ingest, type-2 dimensions, daily marts, serving export."""
