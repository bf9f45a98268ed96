"""Author-corpus analytics as plain PySpark DataFrame functions."""
