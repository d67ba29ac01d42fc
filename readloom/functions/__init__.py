"""Column functions on sequences, edit scripts and scores."""
