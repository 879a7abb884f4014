"""corpusloom: a Spark-native analytics engine for text corpora and the event data around them."""

__version__ = "0.1.0"
