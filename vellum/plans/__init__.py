"""Values that plan queries: tables, databases, connections."""
