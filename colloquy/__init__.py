"""Colloquy: meeting transcripts and speech timelines as Spark DataFrames."""
