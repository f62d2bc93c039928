"""shelfgraph: a PySpark-native product knowledge-graph engine."""
