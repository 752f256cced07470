"""Notice feeds on Spark: discovery, extraction, snapshots, index and feed reads."""
