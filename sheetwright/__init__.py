"""A PySpark-native engine for sheet-style tables, documents and edit logs."""
