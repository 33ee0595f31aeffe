"""A PySpark engine for weighted multisets of pitches and time points."""
