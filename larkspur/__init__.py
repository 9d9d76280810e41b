"""A SQL and full-text engine of an embedded-database dialect, as Spark plans."""


def __getattr__(name: str):
    # loaded when asked for: Python workers that need one module do not load all
    if name in ("Engine", "Row", "Statement"):
        from . import engine

        return getattr(engine, name)
    raise AttributeError(name)
