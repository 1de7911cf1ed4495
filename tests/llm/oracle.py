from ..oracle import same_rows, views

__all__ = ["same_rows", "views"]
