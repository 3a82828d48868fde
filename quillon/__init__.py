"""quillon: a governed analytics engine on PySpark."""

__version__ = "0.1.0"
