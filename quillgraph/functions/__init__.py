"""Column functions: text, JSON and token budgets.  All are built-in expressions, so they stay in generated code."""
