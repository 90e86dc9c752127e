"""Column functions: windows over a series, scalar rules, and folds."""
