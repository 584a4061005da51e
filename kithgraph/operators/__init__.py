"""Graph operators: functions from a ``Net`` to a DataFrame (or, for tests and regressions, a result object)."""
