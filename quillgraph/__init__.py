"""quillgraph: Spark-native analytics over note corpora and the graphs inside them."""

__version__ = "0.1.0"
