"""locuskit: reconciling competing genome annotations on Spark."""
