"""corpuslab: Spark jobs for curating, evaluating and reviewing example corpora."""

__version__ = "0.1.0"
