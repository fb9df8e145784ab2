from . import adapters, readers, schemas, sinks

__all__ = ["adapters", "readers", "schemas", "sinks"]
