"""A Spark-first analytics engine: catalog, relational operators, expressions, query suite, analysis."""
