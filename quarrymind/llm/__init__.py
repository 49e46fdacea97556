"""Operators for preparing large text corpora for training. Nothing else in the package imports this folder."""
