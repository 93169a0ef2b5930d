"""Operators that prepare texts for training. Nothing else imports this."""
