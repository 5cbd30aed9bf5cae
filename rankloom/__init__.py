"""rankloom: learning-to-rank data work as Spark DataFrame operators."""

__version__ = "0.1.0"
