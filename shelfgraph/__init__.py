"""shelfgraph: publication-catalogue graph analytics on Spark DataFrames."""

from shelfgraph.graph import Graph
from shelfgraph.session import get_spark, work_dir

__all__ = ["Graph", "get_spark", "work_dir"]
