"""chainloom: immune-receptor sequence corpora as declarative Spark plans."""

__version__ = "0.1.0"
