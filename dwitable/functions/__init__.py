"""Column functions: everything here maps columns to columns and stays inside code generation."""
