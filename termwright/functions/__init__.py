"""Column functions of the vocabulary engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> list[str]:
    """Make scalar functions callable from SQL. They are SQL expressions: no Python runs."""
    from . import cleaning, kana, tables

    def replaced(expression: str, *patterns: str) -> str:
        for pattern in patterns:
            expression = f"regexp_replace({expression}, {_text(pattern)}, ' ')"
        return expression

    letters = ", ".join(_text(x) for pair in tables.LETTERS.items() for x in pair)
    known = ", ".join(_text(x) for pair in tables.CANONICAL.items() for x in pair)
    blanked = replaced("coalesce(s, '')", cleaning.TAGGED, cleaning.STRAY_TAG, cleaning.FENCE, cleaning.OPEN_FENCE, cleaning.PLACEHOLDER, cleaning.URL, cleaning.PATH)
    syllables = ", ".join(_text(x) for pair in (tables.romaji_table() | {"'": ""}).items() for x in pair)
    pieces = f"regexp_extract_all(t, {_text(kana._segments())}, 0)"
    narrow = f"translate(s, {_text(kana._WIDE + '　')}, {_text(kana._NARROW + ' ')})"
    h = "sha1(concat_ws('\\t', reading, word))"
    bodies = {
        "katakana_to_hiragana(s STRING)": f"translate(s, {_text(kana._KATAKANA)}, {_text(kana._HIRAGANA)})",
        "hiragana_to_katakana(s STRING)": f"translate(s, {_text(kana._HIRAGANA)}, {_text(kana._KATAKANA)})",
        "acronym_reading(s STRING)": "if(s rlike '^(?=.*[A-Z])[A-Z0-9]{2,6}$', array_join(transform(split(lower(s), '(?!^)(?!$)'), c -> element_at(map(" + letters + "), c)), ''), NULL)",
        "romaji_to_hiragana(s STRING)": f"if(coalesce(s, '') = '', NULL, transform(array(replace(replace(lower({narrow}), '’', '\\''), '-', '')), "
        f"t -> if(array_join({pieces}, '') = t, array_join(transform({pieces}, p -> coalesce(try_element_at(map({syllables}), p), 'っ')), ''), NULL))[0])",
        "canonical_spelling(s STRING)": f"element_at(map({known}), lower(s))",
        "clean_text(s STRING)": f"array_join(filter(split({blanked}, {_text(cleaning.LINE_BREAK)}, -1), x -> not x rlike {_text(cleaning.NOISE)} and x rlike '[{tables.LINE_JAPANESE}]'), '\\n')",
        "stable_id(word STRING, reading STRING)": f"upper(concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), concat('5', substr({h}, 14, 3)), concat(translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr({h}, 18, 3)), substr({h}, 21, 12)))",
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")
    return [s.split("(")[0] for s in bodies]
