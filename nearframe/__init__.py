"""Vector search, graph analytics and data preparation as ordinary Spark plans."""
