"""registra: DataFrame operators for registries of research projects."""

__version__ = "0.1.0"
