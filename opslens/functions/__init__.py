from . import columns, labels, text, times

__all__ = ["columns", "labels", "text", "times"]
