"""lodestone: a PySpark-native engine for text security and trial analytics."""
