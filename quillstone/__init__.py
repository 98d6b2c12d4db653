"""quillstone: a Spark-native store and query engine for confidence-weighted knowledge."""
