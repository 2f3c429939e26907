"""Text functions as column expressions: cleaning, normalising, tokens and stems."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop-words of both tokenizers, and the pattern of a token.
STOPWORDS = (
    "a al algo algun alguna algunas algunos con cual cuando de del donde el ella en es esta este hay la las lo los me mi mis para pero por que quiero "
    "se ser su sus te tener tu tus un una unas uno unos ver y ya yo busco buscar lugar lugares necesito puedo"
).split()
TOKEN = "[a-z0-9]+"


def _plain() -> tuple[str, str]:
    """Letters that are one other letter once they are decomposed and lose their accents, and those letters; by Unicode's
    compatibility decomposition. Ideographs and syllables stay as they are."""
    pairs = []
    for c in map(chr, [*range(0x80, 0x2E80), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800)]):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain()


def clean(c: Column) -> Column:
    """Null becomes empty; any run of white space becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def strip_accents(c: Column) -> Column:
    """Letters lose their accents: composed ones by table, loose combining marks by class."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}+", "")


def fold(c: Column) -> Column:
    """Case folding: lower case, and sharp s as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalize(c: Column) -> Column:
    return clean(strip_accents(fold(clean(c))))


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit(TOKEN), F.lit(0))


def _wanted(x: Column) -> Column:
    return ~x.isin(STOPWORDS) & ((F.length(x) > 1) | x.rlike("^[0-9]+$"))


def embedding_tokens(c: Column) -> Column:
    """Tokens for embedding: without stop-words and single letters, or all tokens where none would be left."""
    return F.transform(F.array(raw_tokens(c)), lambda t: F.when(F.size(F.filter(t, _wanted)) > 0, F.filter(t, _wanted)).otherwise(t))[0]


def stem(x: Column) -> Column:
    """Light Spanish stemming: plural, then one gerund or participle ending, else one infinitive ending, else final a or o."""
    ends = lambda w, s: F.endswith(w, F.lit(s))
    drop = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    plural = lambda w: F.when((F.length(w) > 5) & ends(w, "es"), drop(w, 2)).when((F.length(w) > 4) & ends(w, "s"), drop(w, 1)).otherwise(w)

    def rest(w: Column) -> Column:
        out = None
        for suffix, least in [*((s, 3) for s in ("ando", "iendo", "ados", "adas", "idos", "idas")), *((s, 2) for s in ("ar", "er", "ir"))]:
            rule = ends(w, suffix) & (F.length(w) > len(suffix) + least)
            out = F.when(rule, drop(w, len(suffix))) if out is None else out.when(rule, drop(w, len(suffix)))
        return out.when((F.length(w) > 3) & (ends(w, "a") | ends(w, "o")), drop(w, 1)).otherwise(w)

    once = F.transform(F.array(plural(x)), rest)[0]
    return F.when(x.rlike("^[0-9]+$") | (F.length(x) <= 3), x).otherwise(once)


def ranking_tokens(c: Column) -> Column:
    """Tokens for ranking: stop-words and single letters dropped before stemming, nothing put in their place."""
    return F.transform(F.filter(raw_tokens(c), _wanted), stem)


#: How often a place's category and tags are repeated after its document.
CATEGORY_EXTRA, TAGS_EXTRA = 1, 5


def place_tokens(document: Column, category: Column, tags: Column, *others: Column) -> Column:
    """Ranking tokens of a place: its document, or else its other fields (name first, as given) with category and tags, then
    category and tags again by weight. Null and empty fields are passed over."""
    filled = lambda c: F.when(c != "", c)
    base = F.coalesce(filled(document), F.concat_ws(" ", *map(filled, (*others, category, tags))))
    return ranking_tokens(F.concat_ws(" ", base, *[filled(category)] * CATEGORY_EXTRA, *[filled(tags)] * TAGS_EXTRA))


def text_list(c: Column, sep: str = ",") -> Column:
    """The trimmed, non-empty parts of a separated text; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def squeeze_and_cut(c: Column, most: int = 700) -> Column:
    """White space squeezed; longer texts are cut at the last space before the limit and end in three dots."""
    squeezed = clean(c)
    return F.when(F.length(squeezed) > most, F.concat(F.regexp_replace(F.substring(squeezed, 1, most), r" [^ ]*$", ""), F.lit("..."))).otherwise(squeezed)


def any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])
