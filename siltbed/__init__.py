"""siltbed: a Spark-first analytics engine for sparse entity x feature x molecule tables."""
