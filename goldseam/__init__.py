"""Schema drift detection, verified column repair and governed publication on Spark."""

__version__ = "0.1.0"
