"""Coverage analytics on PySpark: who reported on a subject, where, and how well."""
