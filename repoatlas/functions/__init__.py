"""Column expressions: text, encodings, licenses, scores and vectors."""
