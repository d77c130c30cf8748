"""Point-in-time cross-sectional equity analytics on PySpark DataFrames."""

from tidemark.params import Params

__all__ = ["Params"]
