"""A Spark-first analytics engine for brand visibility in AI answers."""
