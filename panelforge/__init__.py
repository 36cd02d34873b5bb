"""panelforge: sparse multi-output factor analysis of panel data as Spark plans."""

__version__ = "0.1.0"
