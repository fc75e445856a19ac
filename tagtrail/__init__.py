"""Sensor readings and technical documents as linked, provenance-carrying Spark tables."""
