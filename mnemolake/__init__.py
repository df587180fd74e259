"""Analytics over personal activity records, expressed as Spark plans."""

__version__ = "0.1.0"
