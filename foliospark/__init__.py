"""foliospark: a PySpark engine for licensed, citable text corpora."""
