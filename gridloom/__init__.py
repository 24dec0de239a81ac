"""gridloom: matrices, point clouds and sparse systems as Spark relations."""

__version__ = "0.1.0"
