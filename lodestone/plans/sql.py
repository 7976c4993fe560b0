"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations


def quoted(s: str | None) -> str:
    return "null" if s is None else "'" + s.replace("'", "''") + "'"


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


def values(rows: list[tuple], names: str) -> str:
    """(select ... from (values ...)) with typed literals."""
    def one(v: object) -> str:
        if isinstance(v, str) or v is None:
            return quoted(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]::varchar[]"
        return str(v).lower() if isinstance(v, bool) else str(v)

    return "(select * from (values " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") as t({names}))"


def any_of(text: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {quoted(p)})" for p in phrases) + ")"


def first_class(text: str, classes: list[tuple[str, list[str]]], default: str | None = None) -> str:
    return "case " + " ".join(f"when {any_of(text, ps)} then {quoted(c)}" for c, ps in classes) + f" else {quoted(default)} end"
