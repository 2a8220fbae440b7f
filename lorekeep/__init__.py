"""Wiki history, link graph and edit activity analytics on Spark."""

__version__ = "0.1.0"
