"""docsift: screening and validation of document collections on Spark."""
