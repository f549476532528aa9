"""tessella: field-data analytics on PySpark. Every operator is DataFrame(s) in, DataFrame out."""
