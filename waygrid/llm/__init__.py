"""Training-data operators: tokenising, scoring, de-duplication, mixing and storage of text corpora.

Each module holds one operator with an interface of its own; ``queries`` registers thin queries over them.
Nothing else in the package imports this subpackage.
"""
