"""lathe: a PySpark-native engine for crawled documentation corpora and training-data preparation."""
