"""strandloom: read-index and assembly-graph analytics on PySpark."""
