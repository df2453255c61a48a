"""innsight: hospitality and workforce BI analyses as Spark DataFrame plans.

Layers:
    functions  column expressions (accent folding, month and resort canonicalisation)
    operators  generic DataFrame operators (filters, paging, aggregates, joins, shapes, ranking)
    sources    ingestion of string tables, table catalog, bindings of the driver's testdata
    plans      the 22 parameterised analyses, composed from the operators
    streaming  nothing: the analysed system is a daily full refresh (see its docstring)
"""

__all__ = ["AnalysisError", "AnalysisResult", "Page", "REGISTRY", "answer", "run"]


def __getattr__(name):
    if name in ("AnalysisResult", "Page"):
        from innsight.plans import spec
        return getattr(spec, name)
    if name == "AnalysisError":
        from innsight.errors import AnalysisError
        return AnalysisError
    if name in ("REGISTRY", "answer", "run"):
        from innsight.plans import registry
        return getattr(registry, name)
    raise AttributeError(name)
