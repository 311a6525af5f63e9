"""Column expressions: built-in Spark functions only, safe with ANSI mode on."""
