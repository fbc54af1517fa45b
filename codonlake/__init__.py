"""codonlake: a PySpark-native engine for codon-phase analytics over large tables."""
