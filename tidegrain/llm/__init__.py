"""Operators for training-data pipelines; nothing else imports them."""
