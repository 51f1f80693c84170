"""folioflow: document-corpus analytics on PySpark DataFrames."""
