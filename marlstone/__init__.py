"""A Spark-native engine: relational operators, text analysis and their queries."""
