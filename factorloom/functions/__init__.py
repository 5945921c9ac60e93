"""Column expressions and the scalable building blocks shared by all operators."""
