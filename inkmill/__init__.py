"""inkmill: document-to-quiz text analytics, written for PySpark."""
