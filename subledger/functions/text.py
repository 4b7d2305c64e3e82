"""Text as column functions: page text, numbers, slugs, normal form and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def html_to_text(html: Column) -> Column:
    """The text of a page: no scripts, styles or tags, four entities decoded, white space collapsed."""
    text = html
    for pattern, new in ((r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, new)
    return F.btrim(text)


def parse_number(raw: Column) -> Column:
    """A localised decimal number: of comma and dot the later one is the decimal mark; a lone comma is one if at most two characters follow it."""
    kept = F.regexp_replace(raw, r"[^0-9,.\-]", "")
    comma, dot = F.instr(kept, ","), F.instr(kept, ".")
    last = lambda mark: F.length(kept) - F.length(F.substring_index(kept, mark, -1))
    first_comma_to_dot = lambda x: F.regexp_replace(F.regexp_replace(x, r"\.", ""), r"^([^,]*),", "$1.")
    no_commas = F.regexp_replace(kept, ",", "")
    decimal_comma = F.when((comma > 0) & (dot > 0), last(",") > last(".")).otherwise(F.length(F.substring_index(kept, ",", -1)) <= 2)
    text = F.when(comma == 0, kept).when(decimal_comma, first_comma_to_dot(kept)).otherwise(no_commas)
    return F.when(kept != "", text.try_cast("double"))


def slugify(name: Column) -> Column:
    slug = F.regexp_replace(F.replace(F.lower(name), F.lit("+"), F.lit(" plus ")), "[^a-z0-9]+", "-")
    return F.regexp_replace(slug, "^-|-$", "")


def normalise(text: Column) -> Column:
    """Lower case, ``+`` as plus, only a-z, 0-9 and single blanks."""
    plain = F.regexp_replace(F.replace(F.lower(text), F.lit("+"), F.lit(" plus ")), "[^a-z0-9 ]", " ")
    return F.btrim(F.regexp_replace(plain, " +", " "))


def threshold(length: Column) -> Column:
    """Edits that a word of this length may be away."""
    return F.when(length <= 3, 0).when(length <= 5, 1).when(length <= 8, 2).otherwise(3)


def word_score(word: Column, target: Column) -> Column:
    """100 for equal words; 80 less 10 for each edit within the threshold, from four letters on; else null."""
    far = F.levenshtein(word, target)
    close = (F.length(word) >= 4) & (F.length(target) >= 4) & (F.abs(F.length(word) - F.length(target)) <= 3)
    return F.when(word == target, 100).when(close & (far <= threshold(F.length(target))), 80 - 10 * far)


def word_matches(word: Column, target: Column) -> Column:
    """Whether two words are equal or within the target's threshold, however short; never for an empty one."""
    a, b = normalise(word), normalise(target)
    return (a != "") & (b != "") & ((a == b) | (F.levenshtein(a, b) <= threshold(F.length(b))))


def phrases_of(phrases: list[str]) -> Column:
    """A literal array of phrases as one expression, so that plans stay small."""
    return F.split(F.lit("|".join(phrases)), r"\|")


def phrase_score(text: Column, words: Column, phrase: Column, score=word_score, per_letter: int = 1) -> Column:
    """How well a normalised ``text`` of ``words`` holds a normalised phrase: as whole words, or the best run of words close to its words; null if it doesn't."""

    def windows(own: Column) -> Column:
        total = lambda i: F.aggregate(F.zip_with(F.slice(words, i + 1, F.size(own)), own, score), 20 * F.size(own), lambda s, x: s + x)
        return F.when(F.size(words) >= F.size(own), F.array_max(F.transform(F.sequence(F.lit(0), F.size(words) - F.size(own)), total)))

    whole = F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), phrase, F.lit(" ")))
    own = F.split(phrase, " ")
    return F.when((text == "") | (phrase == ""), None).when(whole, 1000 + 100 * F.size(own) + per_letter * F.length(phrase)).otherwise(let(own, windows))


def best_match(text: Column, words: Column, phrases: list[str]) -> Column:
    """Struct of the best score and the phrase that has it, the first at a tie; null if none fits."""
    each = F.transform(phrases_of(phrases), lambda p, i: F.struct(phrase_score(text, words, p).alias("score"), (-i).alias("at"), p.alias("phrase")))
    best = F.array_max(F.filter(each, lambda x: x["score"].isNotNull()))
    return F.when(best.isNotNull(), F.struct(best["score"].alias("score"), best["phrase"].alias("phrase")))


def holds(text: Column, words: Column, phrases: list[str]) -> Column:
    return F.exists(phrases_of(phrases), lambda p: phrase_score(text, words, p).isNotNull())
