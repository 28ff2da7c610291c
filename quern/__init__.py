"""quern: a PySpark-native analytics engine of pure DataFrame-to-DataFrame operators."""
