"""spindrift: a PySpark-native analytics engine for project and document corpora."""
