"""Panel analytics for claims-style event data, as PySpark DataFrame operators."""
