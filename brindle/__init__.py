"""brindle: versioned columnar tables, search and mutation as Spark plans."""

__version__ = "0.1.0"
