"""Operators on text corpora and labelled rows; nothing else in the package imports this one."""
