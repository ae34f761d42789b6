"""Training-data pipeline operators.

Nothing outside this subpackage imports it, so it can be removed as a whole.
Every operator module exposes a general DataFrame function; the thin
``opN_*`` queries built on them are in :mod:`groundcheck.llm.queries`.
"""
