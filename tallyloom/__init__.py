"""Register linkage and table processing as declarative Spark plans."""
