"""Column expressions: units, names, literals and pseudonyms."""
