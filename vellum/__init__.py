"""vellum: versioned, immutable record tables on plain PySpark."""
