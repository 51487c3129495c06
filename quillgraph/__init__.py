"""Document-knowledge-graph analytics and corpus operators on PySpark."""
