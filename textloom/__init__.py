"""textloom: document analytics and hybrid retrieval as Spark plans."""
