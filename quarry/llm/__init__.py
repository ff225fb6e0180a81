"""Training-data operators over a table of documents. Nothing outside this folder imports it."""
