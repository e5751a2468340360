"""docengine: document collections and corpus processing on PySpark DataFrames."""
