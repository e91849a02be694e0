"""Column-level helpers: names, windows, draws, distribution tails."""
