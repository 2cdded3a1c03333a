"""Operators for training data: matching, groups, survivors, token ids, mixing, subjects."""
