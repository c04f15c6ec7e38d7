"""Training-data pipeline operators.

Nothing outside this subpackage imports it, so it can be removed without
touching the time-series engine.
"""
