"""Operators for preparing training text. Nothing else in packlens imports this subpackage."""
