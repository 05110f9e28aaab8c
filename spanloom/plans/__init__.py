"""Registered queries; importing this package registers all of them."""

from importlib import import_module

_MODULES = ("q_joins", "q_spans", "q_sources", "q_filters", "q_aggs", "q_windows", "q_topk", "q_sets",
            "q_functions", "q_jobs", "q_streams")


def load_all():
    import pkgutil
    have = {m.name for m in pkgutil.iter_modules(__path__)}
    for name in _MODULES:
        if name in have:
            import_module(f"{__name__}.{name}")
