"""quern: a PySpark-native analytics engine for code-knowledge corpora."""
