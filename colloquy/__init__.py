"""colloquy: a Spark-native engine for indexing and searching message corpora."""
