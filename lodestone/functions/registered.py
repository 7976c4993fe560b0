"""The column functions under names that SQL can call: lodestone_tokens(text) and others, as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import rules
from .text import NOT_WORD, WS

_STRIPPED = f"regexp_replace(t, r'^{WS}+|{WS}+$', '')"
_REFERENCES = ", ".join(f"transform(regexp_extract_all(t, r'(?iu){form}', 0), x -> trim(x))" for form in rules.REFERENCE_FORMS)
#: Name, parameters, result and body of each.
FUNCTIONS = [
    ("lodestone_tokens", "t STRING", "ARRAY<STRING>", f"filter(split(lower(t), r'{NOT_WORD}'), x -> x <> '')"),
    ("lodestone_stripped", "t STRING", "STRING", _STRIPPED),
    ("lodestone_content_hash", "t STRING", "STRING", f"md5(regexp_replace(lower({_STRIPPED}), r'{WS}+', ' '))"),
    ("lodestone_slug", "t STRING", "STRING", f"btrim(regexp_replace(regexp_replace(lower({_STRIPPED}), r'{NOT_WORD}', '_'), '_+', '_'), '_')"),
    ("lodestone_references", "t STRING", "ARRAY<STRING>", f"array_distinct(concat({_REFERENCES}))"),
    ("lodestone_windows", "t STRING, size INT, overlap INT", "ARRAY<STRING>", "if(length(t) > 0, transform(sequence(0, greatest(0, length(t) - 1 - overlap), size - overlap), i -> substring(t, i + 1, size)), cast(array() as array<string>))"),
    ("lodestone_paragraphs", "t STRING", "ARRAY<STRING>", f"filter(transform(split(regexp_replace(t, r'\\r\\n?', '\\n'), '\\n'), x -> trim(regexp_replace(x, r'{WS}+', ' '))), x -> x <> '')"),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; the cutters by size run in Arrow. Returns their names."""
    import pandas as pd
    from pyspark.sql import functions as F

    from lodestone.operators.segment import recursive_cuts, smart_cuts

    for name, given, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
    cutters = {"lodestone_smart_cuts": smart_cuts, "lodestone_recursive_cuts": recursive_cuts}
    for name, cut in cutters.items():
        spark.udf.register(name, F.pandas_udf(lambda texts, cut=cut: pd.Series([cut(t or "") for t in texts]), "array<string>"))
    return [f[0] for f in FUNCTIONS] + list(cutters)
