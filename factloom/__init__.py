"""factloom: a Spark-native engine that checks generated text against the tables it was written from."""

__version__ = "0.1.0"
