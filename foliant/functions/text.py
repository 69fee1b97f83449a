"""Column builders over text. None of them leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the semantic types, in the order in which the first match decides (fixed values).
THEOREM = [r"^Theorem\s*\d*[:.]", r"^Lemma\s*\d*[:.]", r"^Corollary\s*\d*[:.]", r"^Proof[:.]", r"\bprove\s+that\b", r"\bQ\.E\.D\."]
DEFINITION = [r"\bis\s+defined\s+as\b", r"\brefers\s+to\b", r"\bmeans\b", r"\bis\s+a\b", r"\bare\s+called\b", r"^Definition:", r"^Def\."]
COMMAND = [r"```(?:bash|sh|shell|zsh|console|terminal)\b", r"^\s*\$\s+\S"]
CODE = [
    r"```(?:python|java|javascript|typescript|go|rust|cpp|c|ruby|php|scala|kotlin|swift|yaml|json|xml|sql|html|css|dockerfile|hcl|terraform|toml|ini|makefile|cmake|r|matlab|lua|perl|elixir|clojure|haskell|ocaml|zig|nim|groovy|powershell|fish)\b"
]
EXAMPLE = [r"\bfor\s+example\b", r"\bfor\s+instance\b", r"\bsuch\s+as\b", r"\be\.g\.\b", r"^Example:", r"^Example\s+\d+"]
PROCEDURE = [r"\bstep\s+\d+\b", r"\bfirst,?\s", r"\bthen,?\s", r"\bfinally,?\s", r"\bnext,?\s", r"^\d+\.\s+", r"^-\s+", r"^Algorithm:", r"^Procedure:"]
PROCEDURE_LEAST = 2
FLAGS = {
    "has_table": r"\|.*\|.*\|",
    "has_code": r"```|`[^`]+`",
    "has_math": r"\$\$|\$[^$]+\$|\\\\?\[|\\\\?\(",
    "has_list": r"(?m)^[\s]*[-*+]\s|^[\s]*\d+\.\s",
    "has_image": r"!\[.*?\]\(.+?\)",
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def estimate_tokens(c: Column | str) -> Column:
    """0 for null and empty text, else a fourth of the characters, 1 at least."""
    n = F.coalesce(F.length(_c(c)), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def word_count(c: Column | str) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(_c(c), F.lit(r"(?U)\S+")), F.lit(0))


def _any(c: Column, patterns: list[str], flags: str) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(f"(?{flags}){p}") for p in patterns])


def semantic_type(c: Column | str) -> Column:
    """theorem, definition, cli_command, code_example, example, procedure or narrative; null text is narrative."""
    c = F.coalesce(_c(c), F.lit(""))
    steps = reduce(lambda a, b: a + b, [c.rlike(f"(?imd){p}").cast("int") for p in PROCEDURE])
    return (
        F.when(_any(c, THEOREM, "imd"), "theorem").when(_any(c, DEFINITION, "imd"), "definition").when(_any(c, COMMAND, "md"), "cli_command")
        .when(_any(c, CODE, "md"), "code_example").when(_any(c, EXAMPLE, "imd"), "example").when(steps >= PROCEDURE_LEAST, "procedure").otherwise("narrative")
    )


def content_flags(c: Column | str) -> dict[str, Column]:
    c = F.coalesce(_c(c), F.lit(""))
    return {k: c.rlike(p.replace("(?m)", "(?md)")) for k, p in FLAGS.items()}


def header_info(c: Column | str) -> dict[str, Column]:
    """header_text, header_level and block_type of a first line that is a markdown heading; null otherwise."""
    first = F.split_part(_c(c), F.lit("\n"), F.lit(1))
    marks, text = (F.regexp_extract(first, r"^(#{1,6})\s+(.+)$", i) for i in (1, 2))
    is_one = F.length(marks) > 0
    return {"header_text": F.when(is_one, F.trim(text)), "header_level": F.when(is_one, F.length(marks)), "block_type": F.when(is_one, F.lit("Header"))}


def topic_tags(c: Column | str, most: int = 5) -> Column:
    """Bold, italic, defined and capitalised phrases of 2 to 50 characters, shortest first, ties by text."""
    c = F.coalesce(_c(c), F.lit(""))
    found = F.array_union(
        F.array_union(
            F.array_union(F.regexp_extract_all(c, F.lit(r"\*\*([^*]+)\*\*"), 1), F.regexp_extract_all(c, F.lit(r"__([^_]+)__"), 1)),
            F.array_union(F.regexp_extract_all(c, F.lit(r"(?<!\*)\*([^*]+)\*(?!\*)"), 1), F.regexp_extract_all(c, F.lit(r"(?<!_)_([^_]+)_(?!_)"), 1)),
        ),
        F.array_union(
            F.regexp_extract_all(c, F.lit(r"(?i)(?:is\s+a|refers\s+to|called|known\s+as)\s+([A-Za-z][a-z]+(?:\s+[a-z]+)?)"), 1),
            F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), 1),
        ),
    )
    tags = F.array_distinct(F.transform(found, lambda x: F.lower(F.trim(x))))
    tags = F.filter(tags, lambda x: F.length(x).between(2, 50))
    keyed = F.array_sort(F.transform(tags, lambda x: F.struct(F.length(x).alias("n"), x.alias("t"))))
    return F.slice(F.transform(keyed, lambda x: x["t"]), 1, most)


def formatted_terms(c: Column | str) -> Column:
    """Bold, then italic terms of one to six words; of spellings that differ in case the first stays."""
    c = F.coalesce(_c(c), F.lit(""))
    terms = F.concat(F.regexp_extract_all(c, F.lit(r"\*\*([^*]+)\*\*"), 1), F.regexp_extract_all(c, F.lit(r"(?<!\*)\*([^*]+)\*(?!\*)"), 1))
    terms = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: F.regexp_count(t, F.lit(r"\S+")).between(1, 6))
    lows = F.transform(terms, F.lower)
    return F.filter(terms, lambda t, i: F.array_position(lows, F.lower(t)) == i + 1)


def slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(F.trim(_c(c))), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")


def singular(c: Column) -> Column:
    """ies to y, es and s dropped, with guards for short words and words in ss."""
    n = F.length(c)
    return (
        F.when(c.endswith("ies") & (n > 4), F.concat(c.substr(F.lit(1), n - 3), F.lit("y")))
        .when(c.endswith("es") & (n > 3), c.substr(F.lit(1), n - 2))
        .when(c.endswith("s") & ~c.endswith("ss") & (n > 2), c.substr(F.lit(1), n - 1)).otherwise(c)
    )


def singular_slug(c: Column | str) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.trim(_c(c))), r"(?U)[^\w\s-]", ""), r"(?U)\s+")
    return F.regexp_replace(F.array_join(F.transform(F.filter(words, lambda w: w != ""), singular), "-"), "-+", "-")


def file_slug(c: Column | str, lowercase: bool = False) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(c), r"(?U)[^\w\-]", "_"), "_+", "_"), "^_+|_+$", "")
    s = F.coalesce(F.nullif(s, F.lit("")), F.lit("document"))
    return F.lower(s) if lowercase else s


def display_slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(c)), r"(?U)[^\w\s-]", ""), r"(?U)[\s_-]+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 80), F.lit("")), F.lit("unnamed"))


def graph_id(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(c), r"(?U)[^\w]", "_"))


def file_stem(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+?)(\.[^./]*)?$", 1)


def title_of(path: Column | str, content: Column | str, given: Column | None = None) -> Column:
    """The given title, else the first ``# `` line, else the file's stem."""
    head = F.nullif(F.trim(F.regexp_extract(_c(content), r"(?md)^\s*# (.*)$", 1)), F.lit(""))
    return F.coalesce(*([given] if given is not None else []), head, file_stem(path))


def preview(c: Column | str, n: int = 3000, suffix: str = "...") -> Column:
    c = _c(c)
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n)), F.lit(suffix)))


def sentences(c: Column | str) -> Column:
    """Sentences of a text: a cut after . ! or ? and white space."""
    return F.filter(F.transform(F.split(F.trim(_c(c)), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def lead(c: Column | str, n: int = 3) -> Column:
    """The first n sentences: the summary that needs no model."""
    return F.array_join(F.slice(sentences(c), 1, n), " ")


def file_size(c: Column | str) -> Column:
    c = _c(c).cast("double")
    out = F.when(c < 1024, F.format_string("%.1f B", c))
    for i, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(c < 1024.0 ** (i + 1), F.format_string(f"%.1f {unit}", c / 1024.0**i))
    return out.otherwise(F.format_string("%.1f TB", c / 1024.0**4))


def json_list(c: Column | str) -> Column:
    """A JSON list of strings as an array; null, blank and broken JSON give an empty one."""
    return F.coalesce(F.from_json(_c(c), "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def flag_text(table: Column, code: Column, math: Column) -> Column:
    return F.concat_ws(" ", F.when(table, "[TABLE]"), F.when(code, "[CODE]"), F.when(math, "[MATH]"))
