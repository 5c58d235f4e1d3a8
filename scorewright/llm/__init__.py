"""Operators for preparing training text: archives, classifiers, de-duplication, counting and mixing."""
