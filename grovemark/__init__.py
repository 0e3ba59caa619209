"""Ontology annotation analytics expressed as Spark DataFrame plans."""
