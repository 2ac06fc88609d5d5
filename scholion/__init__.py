"""scholion: a PySpark-native engine for corpora of scholarly records."""
