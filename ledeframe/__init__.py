"""ledeframe: the data side of short-text classifier training, as Spark DataFrame operators."""

__version__ = "0.1.0"
