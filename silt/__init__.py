"""Evidence-weighted, bitemporal knowledge from transcripts, as Spark DataFrames."""
