"""catalogsmith: bibliographic metadata preparation on PySpark."""
