"""Lodestone: structural analytics over code facts and ordinary tables, on Spark."""
