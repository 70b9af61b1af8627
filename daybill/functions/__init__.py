"""Column functions. All of them compile to built-in expressions; no Python runs per row."""
