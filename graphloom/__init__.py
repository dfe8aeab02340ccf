"""Graphloom: graph-augmented retrieval analytics expressed as Spark plans."""
