"""Free-text survey analytics on Spark: plain ``DataFrame -> DataFrame`` functions over Catalyst expressions."""

__version__ = "0.1.0"
