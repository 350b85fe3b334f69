"""Quality rules: distance of each document's histograms from its language's reference.

Only built-in expressions: no Python runs on the executors. Texts are read once, and the counts of
each stay in its row, on reliable storage; the only shuffle is the one that sums the histograms
of each language, and beyond MAX_BROADCAST_LANGUAGES languages the one that joins their references.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import merging
from ledgerlens.session import pin

MIN_WORDS = 50
# Texts shorter than this are not judged by their histograms, which would be chance.
GUARD_WORDS = 50
MAX_CLASS_DISTANCE = 0.25
# Of the distance that a text without any common word has from its language's reference.
MAX_WORD_DISTANCE = 0.8
# More references than this are joined by a shuffle.
MAX_BROADCAST_LANGUAGES = 10_000

# The most common words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "with"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "auf", "des"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "las", "se", "del", "un", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
N_CLASSES = 5
N_COMMON = 12

_SPACE = r"[ \t-\r]"
# Punctuation at the ends of a word, but no symbol: a word in symbols is no common word.
_MARK = r"[\p{P}&&[^#*%&@/\\]]"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often later expressions use them.

    A one-element generator between two projections keeps the optimizer from merging them, which
    would evaluate a costly array anew for each use, or for each element inside a lambda.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    own = df.select("*", F.explode(F.array(row)).alias("__once"))
    return own.select(*[F.col(f"`{c}`") for c in df.columns], *[
        F.col(f"__once.{n}").alias(n) for n in columns])


def with_words(df: DataFrame, text: Column) -> DataFrame:
    """Add __t (the text, null as empty) and __w (its words)."""
    df = df.withColumn("__t", F.coalesce(text, F.lit("")))
    # Only the ends can give an empty piece.
    split = F.filter(F.split("__t", f"{_SPACE}+"), lambda w: w != "")
    return once(df, __w=split)


def class_counts() -> Column:
    """Characters of __t: lower-case letters, white space, other letters, digits, the rest."""
    return F.expr(rf"""
        transform(array(regexp_replace(__t, '\\p{{Ll}}+', '')), a ->
        transform(array(regexp_replace(a, '\\s+', '')), b ->
        transform(array(regexp_replace(b, '\\p{{L}}+', '')), c ->
        transform(array(regexp_replace(c, '\\p{{N}}+', '')), d -> array(
            length(__t) - length(a), length(a) - length(b), length(b) - length(c),
            length(c) - length(d), length(d)))[0])[0])[0])[0]""")


def common_list(language: Column) -> Column:
    """The common words of a language; of a language without a list, none."""
    out = F.lit(None)
    for name, words in COMMON_WORDS.items():
        out = F.when(language == name, F.array(*[F.lit(w) for w in words])).otherwise(out)
    return out


def word_counts(common: Column) -> Column:
    """How often each common word occurs in __c, the common words of the text, and the rest."""
    each = F.transform(common, lambda c: F.size(F.filter("__c", lambda w: w == c)))
    rest = F.size("__w") - F.aggregate(each, F.lit(0), lambda a, x: a + x)
    return F.concat(each, F.array(rest))


def with_histograms(df: DataFrame, language: Column) -> DataFrame:
    """Add __classes and __common (null for a language without a list); needs __t and __w.

    Common words are matched in lower case, without punctuation at their ends.
    """
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    # All words at once; each run of marks is tried from its first one only.
    plain = F.split(F.regexp_replace(
        F.lower(F.array_join("__w", " ")),
        f"(?<![^ ]){_MARK}++|(?<!{_MARK}){_MARK}++(?![^ ])", ""), " ")
    df = once(df, __c=F.filter(plain, lambda w: w.isin(every)))
    return once(df, __classes=class_counts(), __common=word_counts(common_list(language)))


def references(counted: DataFrame) -> DataFrame:
    """One row per language: __rl, and the shares of its summed histograms, __a and __b.

    The sums are over all rows of __l, __n, __classes and __common that are long enough, so every
    language of a document that is judged by its histograms has its row. __b is null for a language
    without a list of common words.
    """
    sums = [F.sum(F.col("__classes")[i]).alias(f"a{i}") for i in range(N_CLASSES)]
    sums += [F.sum(F.get("__common", F.lit(i))).alias(f"b{i}") for i in range(N_COMMON + 1)]
    rows = counted.filter(F.col("__n") >= GUARD_WORDS).groupBy(F.col("__l").alias("__rl")).agg(*sums)
    return pin(rows.select("__rl", _shares("a", N_CLASSES).alias("__a"),
                           _shares("b", N_COMMON + 1).alias("__b")))


def _shares(prefix: str, n: int) -> Column:
    """The sums as parts of their total; null if they are null or all zero."""
    names = [f"{prefix}{i}" for i in range(n)]
    total = f"nullif({' + '.join(names)}, 0)"
    return F.expr(f"if({total} IS NULL, NULL, array({', '.join(f'{c} / {total}' for c in names)}))")


def with_references(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Add __a and __b of the row's language __l."""
    if refs.limit(MAX_BROADCAST_LANGUAGES + 1).count() > MAX_BROADCAST_LANGUAGES:
        return merging.lookup(docs, refs, "__l", "__rl")
    return docs.join(F.broadcast(refs), F.col("__l") == F.col("__rl"), "left").drop("__rl")


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram from a reference; null if empty."""
    half = lambda a, b: f"if({a} > 0, {a} * ln({a} * 2 / ({a} + {b})), 0D)"
    return F.expr(f"""
        sqrt(abs(aggregate(zip_with(
            transform({counts}, c -> c / nullif(
                aggregate({counts}, 0D, (s, c) -> s + c), 0D)), {reference},
            (p, q) -> {half("p", "q")} + {half("q", "p")}), 0D, (s, v) -> s + v)
            / {2 * math.log(2)}D))""")


def repeated_words() -> Column:
    """Words inside three-word windows that occur twice or more; needs __w and __s.

    __s holds, sorted, half of each window's hash over its position. Neighbours with equal halves
    are compared by the whole 64-bit hash, sorted again, and the windows left are merged.
    """
    return F.expr("""
        aggregate(
          transform(array(
            sort_array(transform(
              filter(__s, (x, k) -> x div 4294967296 = coalesce(get(__s, k - 1), 0) div 4294967296
                OR x div 4294967296 = coalesce(get(__s, k + 1), 0) div 4294967296),
              x -> struct(
                xxhash64(__w[cast(x % 4294967296 AS INT)], __w[cast(x % 4294967296 AS INT) + 1],
                  __w[cast(x % 4294967296 AS INT) + 2]) AS h,
                cast(x % 4294967296 AS INT) AS i)))), c ->
            sort_array(transform(
              filter(c, (x, k) -> x.h <=> get(c, k - 1).h OR x.h <=> get(c, k + 1).h),
              x -> x.i)))[0],
          struct(0L AS n, -3 AS at),
          (a, p) -> struct(a.n + least(3, p - a.at) AS n, p AS at),
          a -> a.n)""")


def windows_sorted() -> Column:
    """Per window of three words: 31 bits of its hash above its position, sorted."""
    return F.expr("""
        sort_array(transform(
          if(size(__w) >= 3, sequence(0, size(__w) - 3), cast(array() AS array<int>)),
          i -> shiftrightunsigned(xxhash64(__w[i], __w[i + 1], __w[i + 2]), 33) * 4294967296 + i))
        """)


def judge(
    docs: DataFrame,
    into: str = "quality",
    text_column: str = "text",
    language_column: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add a struct with the counts, both distances and the verdict of each document.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are counted over the whole
    text. base_failed: fewer than 50 words, or over half of them in repeated three-word windows.
    class_distance and word_distance are Jensen-Shannon distances of the text's character classes
    and common words from those of all documents of its language. kept: not base_failed,
    class_distance at most max_class_distance, and word_distance at most max_word_distance times
    the distance that a text without common words has, which depends on the language's share of
    common words alone. Languages whose common words are partly the same stay close: of two such
    (French judged as Spanish) most texts pass.

    A null text counts as empty: no words, base_failed. Texts under GUARD_WORDS words have null
    distances, which reject nothing; so have common words in a language without a list. A null
    language is one of its own, as is every other, however many there are. Equal rows get equal results; an empty table stays empty. An
    input column named as `into` is replaced; others pass unchanged, whatever their names.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() != into.lower()]
    stay = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(columns)]
    df = docs.select(
        *stay, F.coalesce(F.col(f"`{language_column}`"), F.lit("")).alias("__l"),
        F.col(f"`{text_column}`").alias("__x"))
    df = with_histograms(with_words(df, F.col("__x")), F.col("__l"))
    df = once(df, __s=windows_sorted())
    df = once(
        df,
        __n=F.size("__w").cast("bigint"),
        __r=repeated_words(),
        __lines=F.expr(rf"filter(split(__t, '\n', -1), x -> x rlike '[^ \\t-\\r]')"),
    )
    # The texts are read once: what follows needs only their counts.
    counted = pin(df.select(
        *[f"__k{i}" for i in range(len(columns))], "__l", "__n", "__r", "__classes", "__common",
        F.length(F.array_join("__w", "")).cast("bigint").alias("__chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", "[#*$%&|<>]", "")))
        .cast("bigint").alias("__symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("__dup")))
    df = with_references(counted, references(counted))
    guarded = F.col("__n") >= GUARD_WORDS
    df = once(
        df,
        __da=F.when(guarded, distance("__classes", "__a")),
        __db=F.when(guarded, distance("__common", "__b")),
        __dz=F.when(guarded, distance(f"array({'0, ' * N_COMMON}1)", "__b")),
        __fail=(F.col("__n") < MIN_WORDS) | (100 * F.col("__r") > 50 * F.col("__n")),
    )
    far = (F.coalesce(F.col("__da"), F.lit(0.0)) > max_class_distance) | (
        F.coalesce(F.col("__db") > max_word_distance * F.col("__dz"), F.lit(False)))
    result = F.struct(
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__dup").alias("n_dup_lines"),
        F.col("__r").alias("n_repeat_words"),
        F.col("__fail").alias("base_failed"),
        F.col("__da").alias("class_distance"),
        F.col("__db").alias("word_distance"),
        (~F.col("__fail") & ~far).alias("kept"),
    )
    return df.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(columns)], result.alias(into))
