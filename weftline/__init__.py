"""weftline: corpus and segment-state analytics as DataFrame operators."""

__version__ = "0.1.0"
