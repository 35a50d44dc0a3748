"""Every registered query of the library's own operators, and its SQL."""

from . import anchoring, layouts, operators, rules, shared, sources, spans, structure, terms


def queries() -> dict:
    return shared.queries() | rules.queries() | operators.queries() | sources.queries() | spans.queries() | structure.queries() | anchoring.queries() | layouts.queries() | terms.queries()


def oracle_sql() -> dict[str, str]:
    return shared.oracle_sql() | rules.oracle_sql() | operators.oracle_sql() | sources.oracle_sql() | spans.oracle_sql() | structure.oracle_sql() | anchoring.oracle_sql() | layouts.oracle_sql() | terms.oracle_sql()
