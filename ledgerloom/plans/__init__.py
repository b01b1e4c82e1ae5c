"""Named plans over the given tables; importing the modules registers them."""

from importlib import import_module

MODULES = ["reports", "findings", "cleaning", "texts", "models", "storage"]


def _load() -> None:
    for name in MODULES:
        import_module(f"ledgerloom.plans.{name}")


def all_queries():
    from ledgerloom.plans import catalog

    _load()
    return dict(catalog.QUERIES)


def all_twins():
    from ledgerloom.plans import catalog

    _load()
    return dict(catalog.ORACLES)
