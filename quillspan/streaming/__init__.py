"""Journals as batch folds and as stateful streams."""
