"""Spanish stems, by the published Snowball rules, as column rules over a table of words.

A word is looked at once however often it stands in texts: `stem_table` takes the distinct
words and adds the stem of each, step by step, and `term_counts` joins them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import text

# The suffix classes of the published algorithm.
VOWELS = "aeiouáéíóúü"
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ACCENTED_VERBS = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
PLAIN_VERBS = "ando iendo ar er ir".split()
DELETED = (
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas "
    "amiento amientos imiento imientos"
).split()
AGENTS = (
    "adora ador ación acion adoras adores aciones ante antes ancia ancias"
).split()
REPLACED = {
    "logía": "log",
    "logías": "log",
    "ución": "u",
    "ucion": "u",
    "uciones": "u",
    "encia": "ente",
    "encias": "ente",
}
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
VERBS_AFTER_GU = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais "
    "ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá "
    "iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen "
    "aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis "
    "abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos "
    "iéramos iésemos ásemos"
).split()
RESIDUE = "os a o á í ó".split()
STANDARD = (*DELETED, *AGENTS, *REPLACED, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos")
_PLAIN = ("áéíóú", "aeiou")
_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
# From the start of a word up to and with the first consonant after a vowel, once and twice.
FIRST = f"^{_C}*{_V}+{_C}"
SECOND = f"{FIRST}{_C}*{_V}+{_C}"
# The same for the verb region: up to the next vowel, or up to the next consonant.
TO_VOWEL, TO_CONSONANT = f"^..{_C}*{_V}", f"^..{_V}*{_C}"


def _reach(word: Column, pattern: str) -> Column:
    """Where a pattern at the start of the word ends; the length of the word if it isn't there."""
    found = F.length(F.regexp_extract(word, pattern, 0))
    return F.when(found > 0, found).otherwise(F.length(word))


def _suffix(word: Column, suffixes, start: Column | None = None) -> Column:
    """The longest of the suffixes that the word has, behind `start` if that is given; empty if none.

    A search from the left finds the match that begins first, which is the longest at the end.
    """
    region = word if start is None else F.substr(word, start + 1)
    return F.regexp_extract(region, f"(?:{'|'.join(suffixes)})$", 0)


def _without(word: Column, suffix: Column) -> Column:
    return F.left(word, F.length(word) - F.length(suffix))


def _cut(word: Column, suffixes, start: Column) -> Column:
    """The word without its longest suffix, provided that lies behind `start`."""
    suffix = _suffix(word, suffixes)
    shorter = _without(word, suffix)
    return F.when((suffix != "") & (F.length(shorter) >= start), shorter).otherwise(word)


def _standard(base: Column, suffix: Column, second: Column) -> Column:
    """What becomes of a word that loses a standard suffix."""
    adverb = _cut(base, ("iv", "os", "ic", "ad"), second)
    replaced = F.coalesce(*[F.when(suffix == old, F.concat(base, F.lit(new))) for old, new in REPLACED.items()])
    return (
        F.when(suffix.isin(*REPLACED), replaced)
        .when(suffix.isin(*AGENTS), _cut(base, ("ic",), second))
        .when(
            suffix == "amente",
            F.when((adverb != base) & base.endswith("iv"), _cut(adverb, ("at",), second)).otherwise(adverb),
        )
        .when(suffix == "mente", _cut(base, ("ante", "able", "ible"), second))
        .when(suffix.isin("idad", "idades"), _cut(base, ("abil", "ic", "iv"), second))
        .when(suffix.isin("iva", "ivo", "ivas", "ivos"), _cut(base, ("at",), second))
        .otherwise(base)
    )


def stem_table(words: DataFrame) -> DataFrame:
    """word and stem of each row of a table of distinct words (column `word`)."""
    word, col = F.col("word"), F.col
    second_letter_vowel, first_vowel = word.rlike(f"^.{_V}"), word.rlike(f"^{_V}")
    verb = (
        F.when(F.length(word) < 2, F.length(word))
        .when(~second_letter_vowel, _reach(word, TO_VOWEL))
        .when(first_vowel, _reach(word, TO_CONSONANT))
        .otherwise(F.least(F.lit(3), F.length(word)))
    )
    rows = words.select("word", verb.alias("verb"), _reach(word, FIRST).alias("first"), _reach(word, SECOND).alias("second"))
    # A pronoun goes if a verb form stands before it.
    rows = rows.withColumn("base", _without(word, _suffix(word, PRONOUNS)))
    rows = rows.withColumn("ending", _suffix(col("base"), (*ACCENTED_VERBS, *PLAIN_VERBS, "yendo"), col("verb")))
    without_ending = _without(col("base"), col("ending"))
    bare = (
        F.when((col("base") == word) | (col("ending") == ""), word)
        .when(col("ending").isin(*ACCENTED_VERBS), F.concat(without_ending, F.translate("ending", *_PLAIN)))
        .when((col("ending") == "yendo") & ~without_ending.endswith("u"), word)
        .otherwise(col("base"))
    )
    rows = rows.withColumn("bare", bare)
    # A standard suffix goes if it lies far enough behind.
    rows = rows.withColumn("ending", _suffix(col("bare"), STANDARD)).withColumn("base", _without(col("bare"), col("ending")))
    far = F.length("base") >= F.when(col("ending") == "amente", col("first")).otherwise(col("second"))
    shorter = F.when((col("ending") != "") & far, _standard(col("base"), col("ending"), col("second"))).otherwise(col("bare"))
    rows = rows.withColumn("shorter", shorter)
    # Else a verb's ending does.
    rows = rows.withColumn("ending", _suffix(col("bare"), Y_VERBS, col("verb")))
    rows = rows.withColumn("other", _suffix(col("bare"), (*VERBS, *VERBS_AFTER_GU), col("verb")))
    after_y, base = _without(col("bare"), col("ending")), _without(col("bare"), col("other"))
    conjugated = F.when((col("ending") != "") & after_y.endswith("u"), after_y).when(
        col("other").isin(*VERBS_AFTER_GU) & base.endswith("gu"), F.left(base, F.length(base) - 1)
    )
    kept = F.when(col("shorter") != col("bare"), col("shorter")).otherwise(F.coalesce(conjugated, base))
    rows = rows.withColumn("kept", kept)
    # At last a single ending.
    rows = rows.withColumn("ending", _suffix(col("kept"), (*RESIDUE, "e", "é"), col("verb")))
    base = _without(col("kept"), col("ending"))
    gu = col("ending").isin("e", "é") & base.endswith("gu") & (F.length(base) - 1 >= col("verb"))
    stem = F.translate(F.when(gu, F.left(base, F.length(base) - 1)).otherwise(base), *_PLAIN)
    # The words are distinct and stay where they are; as an aggregate, the steps aren't written out
    # again into conditions on the stem.
    return rows.groupBy("word").agg(F.max(stem).alias("stem"))


def term_counts(rows: DataFrame, key: str, passes: int = 1) -> DataFrame:
    """key, term, tf: the stems of the words of a text (column `key`, the text itself) and how often each stands.

    Stop words are left out before every pass. Rows with the same text are one.
    """
    # One expression text: hundreds of literals, each built by itself, take longer than the job.
    stop = ", ".join(f"'{word}'" for word in text.spanish_stopwords())
    counts = (
        rows.select(key)
        .distinct()
        .select(key, F.explode(text.raw_words(F.col(key))).alias("word"))
        .where(f"word not in ({stop})")
        .groupBy(key, "word")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    words = counts.select("word").distinct()
    stems = stem_table(words)
    for _ in range(passes - 1):
        again = stem_table(stems.where(f"stem not in ({stop})").select(F.col("stem").alias("word")).distinct())
        stems = stems.join(again.toDF("stem", "again"), "stem").select("word", F.col("again").alias("stem"))
    return counts.join(stems, "word").groupBy(key, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
