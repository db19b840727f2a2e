"""docloom: document retrieval, grounding and corpus preparation as Spark plans."""
