"""weftline: dependency-graph and text analytics on PySpark DataFrames."""
