"""Column expressions that the jobs use."""
