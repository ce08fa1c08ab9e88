"""objsql: read-only SQL over stored objects and object-catalog processing on Spark."""
