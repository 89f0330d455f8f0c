"""A Spark-native document-intelligence engine: documents as tables, tools as set-at-a-time queries."""
