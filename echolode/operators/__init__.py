"""Data frame operators: windows, vectors, scores, roll-up, clusters."""
