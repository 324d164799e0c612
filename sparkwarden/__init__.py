"""sparkwarden: static analysis of large source-text corpora as Spark plans."""
