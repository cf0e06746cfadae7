"""Column expressions and small frame helpers the operators are made of."""
