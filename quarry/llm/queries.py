"""The registered queries of this package and the SQL that some of them can be held against."""

from __future__ import annotations

from quarry.llm import bpe, decontamination, exact_dedup, language_id, line_dedup, minhash_dedup, quality, secret_scan, suffix_dedup, token_counts

_MODULES = (exact_dedup, minhash_dedup, suffix_dedup, language_id, token_counts, line_dedup, decontamination, bpe, secret_scan, quality)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE_SQL for m in _MODULES if hasattr(m, "ORACLE_SQL") for name, f in vars(m).items() if name.startswith("op") and callable(f)}
