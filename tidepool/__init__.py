"""tidepool: retrieval, knowledge-graph and corpus analytics on PySpark."""
