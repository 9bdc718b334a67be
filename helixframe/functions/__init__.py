"""Column expressions: text cells, row keys, residues, scores, families. No Python UDFs."""
