"""Operators for training-data pipelines: near duplicates, tokens, language, quality, mixing, chat."""
