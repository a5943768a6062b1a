"""A document-analytics engine on Spark: files in, typed relations, Markdown notes out."""
