"""quillmass: a PySpark-native engine for spectra, literature evidence and reaction networks."""

__version__ = "0.1.0"
