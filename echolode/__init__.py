"""Duplicated and near-duplicated code and text, and operators for training corpora, on Spark."""

from .config import Config, ConfigError, EngineError, load, validate

__version__ = "1.1.0"

__all__ = ["Config", "ConfigError", "EngineError", "ScanResult", "diff", "get_engine", "load", "register_engine", "scan", "scan_tables", "validate"]


def __getattr__(name: str):
    """The engine's own names, read when they are first asked for."""
    if name in ("ScanResult", "diff", "get_engine", "register_engine", "scan", "scan_tables"):
        from .plans import engine

        return getattr(engine, name)
    raise AttributeError(name)
