"""DuckDB SQL for queries of this subpackage.

Its operators are models, transducers and merges that SQL cannot express; tests/llm compares them with brute force, exact
round trips and held-out lines instead.
"""

from __future__ import annotations

SQL: dict[str, str] = {}
