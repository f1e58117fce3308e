"""Reading transcripts and reading and writing tables."""
