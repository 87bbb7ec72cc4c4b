"""strandex: hybrid retrieval analytics and retrieval evaluation as Spark DataFrame plans."""
