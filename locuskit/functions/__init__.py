"""Column expressions: intervals, attribute text, sequence, rules."""
