"""Column functions: text, times and numbers. All are built-in expressions, so that they stay in generated code."""
