"""tarnflow: ordered-stream analytics on PySpark."""
