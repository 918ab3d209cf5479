"""meshlark: navigation-mesh and spatial analytics on PySpark DataFrames."""
