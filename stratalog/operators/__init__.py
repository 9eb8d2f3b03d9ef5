"""Relational, graph and series operators: DataFrame in, DataFrame out."""
