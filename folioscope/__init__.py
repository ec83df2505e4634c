"""A document-intelligence analytics engine made of DataFrame-to-DataFrame functions on Spark."""
