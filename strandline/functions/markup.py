"""Column expressions about LaTeX text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is left out or counts as one word, applied in this order.
# (?d): only a newline ends a line; possessive quantifiers keep long runs off the stack.
STRIPPING = [
    (r"(?d)(?<!\\)%.*", ""),
    (r"(?s)\\begin\{(tabular\*?|tabularx|longtable)\}.*?\\end\{\1\}", " "),
    (r"\\(?:ev|cite|citep|citet|label|includegraphics|input|include|hspace|vspace|setlength|bibitem|usepackage"
     r"|documentclass|graphicspath|newcommand|renewcommand|def)\*?(?:\[[^\]]*\])*+(?:\{[^{}]*\})*+", " "),
    (r"\\(?:figref|tabref|supref|ref|eqref|autoref|cref|Cref)(?:\[[^\]]*\])?\{[^}]*\}", " X "),
    (r"\$[^$]*\$", " X "),
    (r"\\[A-Za-z]+\{\}", " X "),
    (r"\\begin\{[^}]*\}|\\end\{[^}]*\}", " "),
    (r"\\[A-Za-z@]+\*?", " "),
    (r"~", " "),
]
WORD_BREAK = r"(?U)[\s{}\[\]]+|--+"
HEADING = r"\\(section|subsection)\*?\{([^}]*)\}"
INCLUDED = r"\\(?:input|include)\{([^}]+)\}"
SECTION_FILE = r"\\(?:input|include)\{sections/([^}]+?)(?:\.tex)?\}"
EVIDENCE_MARK = r"\\ev\{([^}]*)\}"
ITEM_MARK = r"\\(figref|tabref|supref)(?:\[[^\]]*\])?\{([^}]*)\}"
TABLE_BODY = r"(?s)\\begin\{tabular\*?\}.*?\\end\{tabular\*?\}"
SENTENCE_BREAK = r"(?U)(?<=[.?!])\s+(?=[A-Z\\(])"
NOT_CLAIMS = (r"(?<!\\)%[^\n]*|\\(?:cite|ref|label|input|(?:fig|tab|sup)ref(?:\[[^\]]*\])?|(?:sub)*section\*?|textbf|hl)"
              r"\{[^}]*\}|Loc-\d+|\brs\d+|\bchr\w+|\b\d+[pq]\d+(?:\.\d+)?|\b[A-Z][A-Z0-9-]*\d[A-Z0-9-]*\b"
              r"|\b[A-Za-z]+\d+[A-Za-z]*\b")
SKIPPED_LINE = (r"^(?:\\bibitem|\\begin|\\end|\\(?:sub)*section|\\item|%|\\textbf\{(?:Figure|Table|ST|SF)"
                r"|\\(?:documentclass|usepackage|RequirePackage|newcommand|renewcommand|providecommand|def|setlength"
                r"|setcounter|graphicspath|input|include|geometry|hypersetup|title|author|date)\b)")
CITE_KEY = r"^r\d+$"
SAFE_PATH = r"^[A-Za-z0-9_.\-/]+$"
SAFE_KEY = r"^[A-Za-z0-9.\-]+$"
EVIDENCE_ID = r"^E\d+$"
GENERATED = "% GENERATED"
NO_EVIDENCE = "no-evidence"
# end of fixed values


def prose(text: Column) -> Column:
    """The text without markup."""
    return reduce(lambda t, rule: F.regexp_replace(t, F.lit(rule[0]), F.lit(rule[1])), STRIPPING, text)


def markup_word_count(text: Column) -> Column:
    """Number of words as journals count them: tokens of the prose with a letter or digit."""
    words = F.split(prose(text), WORD_BREAK)
    return F.size(F.filter(words, lambda w: w.rlike("[A-Za-z0-9]")))


def without_comment(line: Column) -> Column:
    """A line up to its comment; a line with an escaped percent sign is kept whole."""
    return F.when(F.contains(line, F.lit("\\%")), line).otherwise(F.substring_index(line, "%", 1))


def normal_text(text: Column) -> Column:
    """Text for comparing quotes: line breaks, end-of-line hyphens, ligatures and quote styles do not matter."""
    plain = F.replace(text, F.lit("\u00ad"), F.lit(""))
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        plain = F.replace(plain, F.lit(ligature), F.lit(letters))
    # few texts hold such signs, and single blanks may stay: what is left alone costs nothing
    plain = F.when(plain.rlike("[\u2018\u2019\u201c\u201d\u2212\u2013]"), F.translate(plain, "\u2018\u2019\u201c\u201d\u2212\u2013", "''''--")).otherwise(plain)
    plain = F.regexp_replace(plain, r"(?U)-\s*\n\s*", "")
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s\s+|[\s&&[^ ]]", " ")))
