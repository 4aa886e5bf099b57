"""Functions of the read-index and assembly-graph engine."""
