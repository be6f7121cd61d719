"""A Spark-native engine that builds and audits a provenance-preserving knowledge graph."""
