"""folioq: a document-query analytics engine on PySpark."""
