"""spantrack: a Spark-first engine for positional tracks and the data around them."""

__version__ = "0.1.0"
