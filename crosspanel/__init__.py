"""Cross-sectional panel analytics as plain PySpark functions."""
