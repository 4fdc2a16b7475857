"""Text expressions. All of them stay on the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cobaltmill.functions import vocab

# Unicode white space, spelled out so that every engine reads the class the same way.
_NARROW_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
_WIDE_SPACE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = r"\x{20}\x{9}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}" + _WIDE_SPACE
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
HEADER_TOKEN_SPLIT = r"[\s|,;_\-./\\()\[\]]+"


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``, for costly values in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(c, F.lit(_SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(_SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_SPACES))


def norm_text(c: Column) -> Column:
    """Trim, and collapse each run of white space to one space.

    Single plain spaces are already right, so the patterns leave them alone. Texts without
    characters from the wide blocks take a class that the regex engine tests with one bit set.
    """
    def collapsed(odd: str) -> Column:
        return F.regexp_replace(c, f"[ {odd}]{{2,}}|[{odd}]", " ")

    wide = c.rlike(r"[^\x{0}-\x{167f}]")
    return F.trim(F.when(wide, collapsed(_NARROW_SPACE + _WIDE_SPACE)).otherwise(collapsed(_NARROW_SPACE)))


def _accent_table() -> tuple[str, str]:
    source, target = [], []
    for code in range(0x00C0, 0x1F00):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        kept = "".join(p for p in parts if unicodedata.category(p) != "Mn")
        if kept != char and len(kept) == 1:
            source.append(char)
            target.append(kept)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    """Replace accented letters by their base letter and drop loose combining marks."""
    return F.translate(F.regexp_replace(c, r"[\x{300}-\x{36f}]", ""), _ACCENTED, _PLAIN)


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """True when any of ``words`` occurs in ``c``."""
    return reduce(or_, [c.contains(w) for w in words])


def cap_text(c: Column, limit: int = vocab.MESSAGE_LIMIT, room: int = 50,
             note: str = vocab.CAP_NOTE) -> Column:
    """Texts over ``limit`` are cut ``room`` characters earlier and get a closing note."""
    cut = F.concat(rstrip(F.substring(c, 1, limit - room)), F.lit(note))
    return F.when(F.length(c) <= limit, c).when(c.isNotNull(), cut).otherwise("")


def extract_fenced(c: Column, tag: str = "python") -> Column:
    """The first fenced block, or the whole text without fence marks; then sanitised."""
    fence = "```"
    block = rf"(?s){fence}{tag}\s*(.*?)\s*{fence}"
    plain = strip(F.replace(F.replace(c, F.lit(fence + tag), F.lit("")), F.lit(fence), F.lit("")))
    body = F.when(c.rlike(block), F.regexp_extract(c, block, 1)).otherwise(plain)
    body = F.regexp_replace(body, r"^[\x{feff}\x{a0}]+", "")
    return F.regexp_replace(body, "[¡¿]", "# ")


def code_like(c: Column) -> Column:
    """Has an analysis mark and at least one line that is neither blank nor a comment."""
    return contains_any(c, vocab.CODE_MARKS) & c.rlike(rf"(?m)^[{SPACE}]*[^{SPACE}#]")


def _object_or_null(candidate: Column) -> Column:
    parsed = F.try_parse_json(candidate)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def json_from_text(c: Column) -> Column:
    """The JSON object between the first ``{`` and the last ``}``; an empty object if invalid."""
    bare = F.regexp_replace(strip(c), r"(?i)^```json\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(_object_or_null(inner), F.parse_json(F.lit("{}")))


def chart_json(c: Column) -> Column:
    """The chart object in an answer: a chart fence first, else the first valid marked line."""
    fence = r"(?is)```echarts-json\s*(.*?)\s*```"
    fenced = _object_or_null(F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)))
    inner = F.try_variant_get(fenced, "$.echarts_option", "variant")
    wrapped = F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner)
    from_fence = F.when(inner.isNull(), fenced).otherwise(wrapped)
    lines = F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]*ECHARTS_JSON_OUTPUT:[ \t]*(.*?)[ \t]*$"), 1)
    objects = F.filter(
        F.transform(lines, _object_or_null),
        lambda v: F.schema_of_variant(v).startswith("OBJECT") & (F.schema_of_variant(v) != "OBJECT<>"),
    )
    from_line = F.get(objects, F.lit(0))
    return F.when(c.rlike(fence), from_fence).otherwise(from_line)


def intent(c: Column) -> Column:
    """``prediction`` when a stock or forecast word occurs, else ``analysis``."""
    hit = contains_any(F.lower(c), vocab.PREDICTION_WORDS)
    return F.when(hit, "prediction").otherwise("analysis")


def wants_chart(c: Column, has_data: Column) -> Column:
    return has_data | contains_any(F.lower(c), vocab.CHART_WORDS)


def work_budget(c: Column, styled: Column, has_data: Column, chart: Column,
                ceiling: int = 330) -> Column:
    """Seconds planned for one request."""
    total = (
        F.lit(90)
        + F.when(F.octet_length(c) > 500, 30).otherwise(0)
        + F.when(styled, 90).otherwise(0)
        + F.when(has_data, 120).otherwise(0)
        + F.when(chart, 90).otherwise(0)
    )
    return F.least(total, F.lit(ceiling))


def error_class(c: Column) -> Column:
    """First matching error class of a log message, in trial order."""
    lowered = F.lower(c)
    first, *rest = vocab.ERROR_CLASSES
    out = F.when(contains_any(lowered, first[1]), first[0])
    for name, words in rest:
        out = out.when(contains_any(lowered, words), name)
    return out.otherwise("other")


def domain_of_columns(joined: Column) -> Column:
    """Domain of a table from its joined column names."""
    hit = contains_any(F.lower(joined), vocab.COMPLIANCE_WORDS)
    return F.when(hit, "financial_compliance").otherwise("general_analytics")


def catalog_name(column_name: Column) -> Column:
    """Catalog that a column name selects, or null."""
    lowered = F.lower(column_name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for words, catalog in vocab.CATALOG_RULES:
        out = out.when(contains_any(lowered, words), catalog)
    return out


# --- fixed values: the lines of the report style contract ---------------------------------------
STYLE_CONTRACT = (
    "CONTRATO DE ESTILO ACTUAL:\n"
    "- Perfil del stakeholder: %s\n"
    "- Estilo de lenguaje: %s\n"
    "- Dialecto / región: %s\n"
    "- Color primario: %s | Secundario: %s\n"
    "- Tamaños: cuerpo %d pt, títulos %d pt\n"
)
# ------------------------------------------------------------------------------------------------


def style_block(profile: Column, language: Column, dialect: Column, primary: Column,
                secondary: Column, body_size: Column, title_size: Column) -> Column:
    """The report style contract of one configuration row as text."""
    return F.format_string(
        STYLE_CONTRACT, profile, language, dialect, primary, secondary, body_size, title_size,
    )
