"""Relational, feature, model, metric and corruption operators as functions of DataFrames."""
