"""Evidence retrieval, verification and corpus operators as Spark plans."""
