"""quillmesh: a PySpark engine for document and source-code knowledge bases."""

__version__ = "0.1.0"
