"""reelspan: a PySpark-native engine for temporal grounding over multimodal scene tables."""

__version__ = "0.1.0"
