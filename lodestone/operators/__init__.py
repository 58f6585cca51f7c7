"""Generic relational operators, parameterised by column names."""
