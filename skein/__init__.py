"""skein: evidence retrieval, comparison and corpus analytics as Spark plans."""
