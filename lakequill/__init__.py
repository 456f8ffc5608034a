"""lakequill: document-collection analytics expressed as Spark DataFrame plans."""
