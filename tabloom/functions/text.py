"""Text clean-up used by scoring, matching and question templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLANK = r"[\s\p{Z}]+"
PUNCTUATION = r"""[!"#$%&'()*+,\-/:;<=>?@\[\\\]^_`{|}~]"""
ARTICLE = r"(?U)\b(a|an|the)\b"
LABEL_DROP = r"[^a-z0-9.\- %]+"
OPERATOR_WORDS = {
    "=": "is",
    "!=": "is not",
    "<>": "is not",
    ">": "is greater than",
    "<": "is less than",
    ">=": "is greater than or equal to",
    "<=": "is less than or equal to",
}
CAMEL_WORD = r"[A-Z]+(?=[A-Z][a-z]|$)|[A-Z]?[a-z]+|\d+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, BLANK, " "))


def normalize_answer(text: Column) -> Column:
    """Lower case, no punctuation but dots, no articles, single blanks."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, ARTICLE, " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda t: t != "")


def normalize_alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "")


def yes_no_prefix(text: Column) -> Column:
    return F.when(text.startswith("yes"), "yes").when(text.startswith("no"), "no").otherwise(text)


def strip_percent(text: Column) -> Column:
    return strip(F.replace(text, F.lit("%"), F.lit("")))


def drop_code_fences(text: Column) -> Column:
    """Remove fence marks of closed code blocks together with the language line.

    Splitting at the marks pairs them in reading order; a piece between two marks is a block.
    """
    pieces = F.split(text, "```", -1)
    last = F.array_repeat(F.size(pieces) - 1, F.size(pieces))

    def clean(piece, i):
        body = F.when(
            F.instr(piece["p"], "\n") > 0, F.regexp_replace(piece["p"], r"^[^\n]*\n", "")
        ).otherwise(F.concat(F.lit("```"), piece["p"]))
        block = F.when(i < piece["last"], body).otherwise(F.concat(F.lit("```"), piece["p"]))
        return F.when(i % 2 == 1, block).otherwise(piece["p"])

    cleaned = F.transform(F.arrays_zip(pieces.alias("p"), last.alias("last")), clean)
    return F.when(F.instr(text, "```") == 0, text).otherwise(F.array_join(cleaned, ""))


def strip_markdown(text: Column) -> Column:
    """Plain text of a model output: no fences, inline code, bold, italic, quotes or ``python``."""
    plain = drop_code_fences(text)
    plain = F.regexp_replace(plain, r"`([^`]*)`", "$1")
    plain = F.regexp_replace(plain, r"\*\*([^\n]*?)\*\*", "$1")
    plain = F.regexp_replace(plain, r"\*([^\n]*?)\*", "$1")
    plain = F.regexp_replace(plain, r"(?md)^>\s?", "")
    return strip(F.replace(plain, F.lit("python"), F.lit("")))


def after_last_marker(text: Column, marker: str) -> Column:
    """Text behind the last occurrence of a marker in any case; empty without one."""
    return strip(F.regexp_extract(text, f"(?is)^.*{marker}(.*)$", 1))


def first_list_element(text: Column) -> Column:
    """First element of a list literal, or the text itself."""
    inner = F.regexp_extract(text, r"""^\s*\[\s*(?:'([^']*)'|"([^"]*)"|([^,\]]*))""", 0)
    value = F.regexp_replace(F.regexp_replace(inner, r"^\s*\[\s*", ""), r"""^['"]|['"]$""", "")
    return F.when(text.rlike(r"^\s*\[[^\n]*\]\s*$"), value).otherwise(text)


def strip_quotes(text: Column) -> Column:
    """Remove one pair of matching quotes."""
    return F.regexp_replace(text, r"""^(["'])([\s\S]*)\1$""", "$2")


def camel_to_words(name: Column) -> Column:
    return F.lower(F.array_join(F.regexp_extract_all(name, F.lit(f"({CAMEL_WORD})"), 1), " "))


def predicate_text(col: Column, op: Column, value: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in OPERATOR_WORDS.items() for x in pair])
    return F.concat(camel_to_words(col), F.lit(" "), words[op], F.lit(' "'), value, F.lit('"'))


def replace_many(text: Column, replacements: dict[str, str]) -> Column:
    """Replace several substrings at once; longer keys win."""
    escape = str.maketrans({c: "\\" + c for c in r"\.^$*+?{}[]|()"})
    alternatives = "|".join(k.translate(escape) for k in sorted(replacements, key=len, reverse=True))
    table = F.create_map(*[F.lit(x) for pair in replacements.items() for x in pair])
    between = F.split(text, alternatives, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({alternatives})"), 1), lambda k: table[k])
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def normalize_label(text: Column) -> Column:
    """Comparable form of a header or cell label."""
    label = F.translate(F.lower(text), "—–", "--")
    label = F.regexp_replace(label, "[_/]+", " ")
    return squeeze(F.regexp_replace(label, LABEL_DROP, " "))


def token_sort(label: Column) -> Column:
    return F.array_join(F.array_sort(F.split(label, " ")), " ")


def paren_parts(text: Column) -> Column:
    """Texts inside parentheses, then the text outside of them."""
    inside = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^\n]*?)\)"), 1), strip)
    outside = squeeze(F.regexp_replace(text, r"\([^\n]*?\)", " "))
    return F.concat(inside, F.array(outside))


def fix_mojibake(text: Column) -> Column:
    """Undo UTF-8 text that was read as Latin-1; anything else stays as it is."""
    latin = text.rlike("[âÃ]") & text.rlike(r"^[\x00-\xFF]*$")
    repaired = F.when(latin, F.encode(text, "ISO-8859-1").cast("string"))
    return F.when(latin & F.is_valid_utf8(repaired), repaired).otherwise(text)


def render_template(template: str, **columns: Column) -> Column:
    """Fill ``{name}`` placeholders; the template is cut once, when the plan is built."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(columns[name])
    return F.concat(*parts)
