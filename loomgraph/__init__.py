"""loomgraph: statement stores and tree-pattern queries on Spark DataFrames."""

__version__ = "0.1.0"
