"""Column expressions over text: normalisation, tokens, lines, slugs, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width signs and their ordinary forms; punctuation that parts words; scripts without blanks (fixed values).
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))
PUNCTUATION = r"[_\-/.,:;!?'\"()\[\]{}<>|\\@#$%^&*+=~`]+"
BLANKS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
CJK = r"\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{fe30}-\x{fe4f}\x{ac00}-\x{d7af}"

#: Synonyms of search terms (fixed values).
SYNONYMS = {
    "deploy": ["deployment", "release", "publish"],
    "deployment": ["deploy", "release"],
    "llm": ["language model", "large language model"],
    "rag": ["retrieval augmented generation"],
    "ci": ["continuous integration"],
    "cd": ["continuous delivery", "continuous deployment"],
    "api": ["interface", "endpoint"],
    "ml": ["machine learning"],
    "dl": ["deep learning"],
    "cv": ["computer vision"],
    "nlp": ["natural language processing"],
    "gpu": ["graphics processing unit"],
    "cpu": ["central processing unit"],
    "k8s": ["kubernetes"],
    "db": ["database"],
    "auth": ["authentication", "authorization"],
    "config": ["configuration"],
    "env": ["environment"],
    "repo": ["repository"],
    "deps": ["dependencies"],
    "docs": ["documentation"],
    "fn": ["function"],
    "impl": ["implementation"],
    "infra": ["infrastructure"],
}


def normalize(text: Column) -> Column:
    """Lower case, ordinary width, punctuation and runs of blanks as one blank, none around."""
    plain = F.regexp_replace(F.translate(F.lower(text), WIDE, NARROW), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(plain, BLANKS, " "))


def tokens(text: Column) -> Column:
    """Bag of terms: words between blanks; for scripts without blanks the whole run and its two- and three-character grams.

    A gram is kept once per text, and not at all if it stood as a run of its own before.
    The order is words, runs, grams. Null and empty texts give the empty array.
    """
    t = normalize(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(t, " "), lambda x: x != "")
    pieces = F.regexp_extract_all(t, F.lit(rf"([{CJK}]+|[^\s{CJK}]+)"), F.lit(1))
    runs = F.filter(pieces, lambda p: p.rlike(f"^[{CJK}]"))
    latin = F.filter(pieces, lambda p: ~p.rlike(f"^[{CJK}]"))
    long_runs = F.filter(runs, lambda r: F.length(r) > 1)
    grams = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
                F.filter(
                    F.flatten(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.array(F.substr(r, i, F.lit(2)), F.when(i <= F.length(r) - 2, F.substr(r, i, F.lit(3)))))),
                    lambda g: g.isNotNull(),
                )
            ),
        )
    )

    def fresh(g: Column) -> Column:
        inside = F.array_position(F.transform(runs, lambda r: r.contains(g)), True)
        alone = F.array_position(runs, g)
        return (alone == 0) | (alone > inside) | (F.length(g) == 1)

    return F.when(t.rlike(f"[{CJK}]"), F.concat(latin, long_runs, F.filter(F.array_distinct(grams), fresh))).otherwise(words)


def expand(terms: Column) -> Column:
    """The distinct terms and the words of their synonyms."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in SYNONYMS.items() for x in (k, sorted({w for s in v for w in s.split()}))])
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(terms, more))


def fuzzy_distance(term: Column) -> Column:
    """Edits that a term tolerates: none below four characters, one up to seven, two beyond; none in scripts without blanks."""
    by_length = F.when(F.length(term) < 4, 0).when(F.length(term) <= 7, 1).otherwise(2)
    return F.when(term.rlike(f"[{CJK}]"), 0).otherwise(by_length)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The last path part without its extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def slugify(text: Column, longest: int = 80) -> Column:
    """Lower case; runs of other signs than letters, digits and CJK become one dash, none at the ends; at most `longest` characters."""
    dashed = F.regexp_replace(F.lower(text), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, longest)


def title_case(text: Column) -> Column:
    """Every ASCII letter or digit at the start of a word in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def round2(x: Column) -> Column:
    """Two decimals, halves up as in floor(100x + 0.5)."""
    return F.floor(x * 100 + 0.5) / 100


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1024 / 1024), F.lit(" MB")))
    )


def percent(x: Column) -> Column:
    return F.concat(F.format_string("%.1f", x * 100), F.lit("%"))


def hash31(text: Column) -> Column:
    """The 32-bit string hash with factor 31, as an absolute value in base 36."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.shiftright(F.shiftleft(a * 31 + c, 32), 32))
    return F.lower(F.conv(F.abs(folded).cast("string"), 10, 36))
