"""Column functions: everything here maps columns to columns and works on streams too."""
