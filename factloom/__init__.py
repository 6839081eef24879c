"""factloom: evidence analytics and training-data processing on PySpark."""
