"""Views of the driver tables and the queries registered on them."""


def load_queries():
    """Import every module that registers queries and return the registry."""
    import importlib

    for name in ("stats", "order", "list", "text", "extract", "stream", "family"):
        importlib.import_module(f"{__name__}.{name}_queries")
    return importlib.import_module(f"{__name__}.registry")
