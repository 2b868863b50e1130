"""Operators on records' copies and names, and on texts in tokens. Nothing else imports this package."""
