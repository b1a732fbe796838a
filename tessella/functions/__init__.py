"""Column expressions and dense linear algebra for small matrices."""
