"""annalist: an archive-grounded memory analytics engine on PySpark DataFrames."""
