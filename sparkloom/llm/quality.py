"""Quality rules: divergence of a document's histograms from those of its language.

Every step is a DataFrame expression; no Python runs on the executors. One scan scores a document; nothing but
the word counts that make the references is shuffled.

Defined cases: a null text counts as empty; a null language is the language ""; a table without rows gives a result
without rows; repeated rows are judged each; columns of the input that have an output's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm._common import TMP, drop_tmp, durable, fenced, text_or_empty

#: Characters are peeled off in this order; what is left last is the class "other".
CLASSES = (r"[a-z]+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"\p{L}+", r"\p{N}+", r"[.,;:!?'\"()\-]+")
#: The place of white space among the classes.
BLANK = 1
MAX_BROADCAST_LANGUAGES = 1000
#: A power of two; a word's slot is the last bits of its hash.
SLOTS = 1024
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@dataclass(frozen=True)
class QualityRules:
    """Limits of the base rules and of the divergence rule.

    A document diverges if its Jensen-Shannon distance (0 to 1) to its language is over the limit, judged only
    from min_chars characters or min_words words on. Listed words are a quarter of a language's, so a text without any is
    just 0.37 away; therefore a document with fewer listed words than its language also diverges if the distance of the
    two shares (listed, not listed) is over max_absence_distance. That limit is 4 % of listed words or so, which 50 words
    of a clean text fall below once in some ten thousand; a language of which under an eighth is listed can't reach it.
    common_words: length of a language's list; a listed word makes up
    at least min_share of the language's words, so that 1 / min_share bounds the list before it is ranked.
    """

    min_base_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    min_chars: int = 200
    min_words: int = 50
    max_char_distance: float = 0.28
    max_word_distance: float = 0.5
    max_absence_distance: float = 0.25
    common_words: int = 32
    min_share: float = 0.002


def _words(text: Column) -> Column:
    """A split at one character needs no regular expression, so other white space becomes blanks first."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def _peel(df: DataFrame, text: str) -> DataFrame:
    """Adds TMP+classes, the characters of each class as an array, and TMP+other, the characters of the last class."""
    names = [text]
    for i, pattern in enumerate(CLASSES):
        df = df.withColumn(f"{TMP}peel{i}", F.regexp_replace(names[-1], pattern, ""))
        names.append(f"{TMP}peel{i}")
    size = [F.length(n) for n in names] + [F.lit(0)]
    counts = F.array(*[(a - b).cast("double") for a, b in zip(size[:-1], size[1:])])
    return df.withColumns({f"{TMP}classes": counts, f"{TMP}other": F.col(names[-1])}).drop(*names[1:])


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: QualityRules = QualityRules()) -> DataFrame:
    """(lang, words, hashes, slots, word_shares, class_shares), a row for each language, from all documents.

    word_shares[0] is the share of all words that are not listed; word i of the list has word_shares[i], from 1, and
    hashes[i - 1]. slots[j] tells whether a hash with the last bits j is in the list. Texts are cut into words once; all
    but the white space of the classes is counted over the distinct words.
    """
    base = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text_or_empty(text_col).alias("text"))
    words = durable(base.select("lang", F.explode(_words(F.col("text"))).alias("word")).groupBy("lang", "word").count())
    chars = base.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    sums = [F.sum(F.col("count") * F.col(f"{TMP}classes")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    classes = _peel(words, "word").groupBy("lang").agg(F.sum("count").alias("n"), *sums)
    number = lambda i: F.coalesce(F.col(f"c{i}"), F.lit(0.0))
    visible = sum((number(i) for i in range(len(CLASSES) + 1)), F.lit(0.0))
    classes = chars.join(classes, "lang", "left").select("lang", "n", "chars", *[(F.col("chars") - visible if i == BLANK else number(i)).alias(f"c{i}") for i in range(len(CLASSES) + 1)])
    classes = durable(classes)
    frequent = words.join(F.broadcast(classes.select("lang", "n")) if classes.count() <= MAX_BROADCAST_LANGUAGES else classes.select("lang", "n"), "lang")
    frequent = frequent.withColumn("share", F.col("count") / F.col("n")).where(F.col("share") >= rules.min_share)
    ranked = frequent.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("rank") <= rules.common_words)
    lists = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "share"))).alias("l"))
    shares = F.coalesce(F.col("l.share"), F.array().cast("array<double>"))
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))
    listed = F.coalesce(F.col("l.word"), F.array().cast("array<string>"))
    hashes = F.transform(listed, lambda w: F.xxhash64(w))
    return classes.join(lists, "lang", "left").select(
        "lang",
        listed.alias("words"),
        hashes.alias("hashes"),
        F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda j: F.array_contains(F.transform(hashes, _slot), j)).alias("slots"),
        F.concat(F.array(rest), shares).alias("word_shares"),
        F.array(*[F.when(F.col("chars") > 0, F.col(f"c{i}") / F.col("chars")).otherwise(0.0) for i in range(len(CLASSES) + 1)]).alias("class_shares"),
    )


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _js_terms(p: Column, q: Column) -> Column:
    """The two terms of the Jensen-Shannon divergence (base 2) for one bin."""
    m = p + q
    return F.when(p > 0, 0.5 * p * F.log2(2 * p / m)).otherwise(0.0) + F.when(q > 0, 0.5 * q * F.log2(2 * q / m)).otherwise(0.0)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), divergence)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def base_counts(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    return drop_tmp(fenced(_counted(docs, text_col, rules), BASE))


def _counted(docs: DataFrame, text_col: str, rules: QualityRules) -> DataFrame:
    """docs with the columns of BASE, and TMP columns chars (how many), classes and h, the hashes of the words.

    Windows are told apart by a 64-bit hash of the hashes of their words, made from those of windows half as long. They
    are sorted only in documents that have a repeated one.
    """
    k = rules.window
    t = lambda n: f"{TMP}{n}"
    df = docs.withColumn(t("text"), text_or_empty(text_col)).withColumn(t("words"), _words(F.col(t("text"))))
    df = _peel(df, t("text"))
    lines = F.filter(F.split(t("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(t("chars"), F.length(t("text"))).withColumns({
        "n_words": F.size(t("words")).cast("long"),
        "word_chars": (F.col(t("chars")) - F.col(t("classes"))[BLANK]).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t("other"), r"[^#*$%&|<>]+", "")).cast("long"),
        t("lines"): lines,
        t("h"): F.transform(t("words"), lambda w: F.xxhash64(w)),
    }).drop(t("words"), t("text"), t("other"))
    df = df.withColumn("n_dup_lines", (F.size(t("lines")) - F.size(F.array_distinct(t("lines")))).cast("long")).drop(t("lines"))
    df, width = df.withColumn(t("g1"), F.when(F.size(t("h")) > k, F.col(t("h")))), 1
    while width < k:  # windows of up to twice as many words, from two that cover them
        step = min(width, k - width)
        g, more = F.col(t(f"g{width}")), F.size(t(f"g{width}")) - step
        df = df.withColumn(t(f"g{width + step}"), F.zip_with(F.slice(g, F.lit(1), more), F.slice(g, F.lit(step + 1), more), lambda x, y: F.xxhash64(x, y))).drop(t(f"g{width}"))
        width += step
    g = F.col(t(f"g{k}"))
    df = df.withColumn(t("s"), F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop(t(f"g{k}"))
    s = F.col(t("s"))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    df = df.withColumn(t("p"), F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["p"]))).drop(t("s"))
    p = F.col(t("p"))
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(t("p"))
    return df.withColumn("base_failed", (F.col("n_words") < rules.min_base_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))


def judge(docs: DataFrame, references: DataFrame | None = None, text_col: str = "text", lang_col: str = "lang", rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with the base counts, char_distance, word_distance (null below the minimum lengths) and kept."""
    refs = durable(language_references(docs, text_col, lang_col, rules) if references is None else references)
    refs = refs.select(*[F.col(c).alias(f"{TMP}ref_{c}") for c in ("lang", "hashes", "slots", "word_shares", "class_shares")])
    if refs.count() <= MAX_BROADCAST_LANGUAGES:  # a row has at most common_words words
        refs = F.broadcast(refs)
    t = lambda n: f"{TMP}{n}"
    df = _counted(docs, text_col, rules).withColumn(t("lang"), F.coalesce(F.col(lang_col), F.lit("")))
    df = df.join(refs, F.col(t("lang")) == F.col(t("ref_lang")), "left")
    n_chars = F.col(t("chars"))
    df = df.withColumn(t("shares"), F.when(n_chars >= rules.min_chars, F.array(*[F.col(t("classes"))[i] / n_chars for i in range(len(CLASSES) + 1)]))).drop(t("classes"))
    bins = [_js_terms(F.col(t("shares"))[i], F.col(t("ref_class_shares"))[i]) for i in range(len(CLASSES) + 1)]
    near = F.filter(t("h"), lambda x: F.get(t("ref_slots"), _slot(x)))
    listed = F.filter(F.transform(near, lambda x: F.array_position(t("ref_hashes"), x)), lambda x: x > 0)
    df = df.withColumns({"char_distance": F.when(F.col(t("shares")).isNotNull(), _distance(sum(bins, F.lit(0.0)))), t("idx"): F.sort_array(listed)}).drop(t("h"), t("shares"))
    idx, q, n = F.col(t("idx")), F.col(t("ref_word_shares")), F.col("n_words")
    df = df.withColumn(t("starts"), F.when(F.size(idx) > 0, F.filter(F.sequence(F.lit(0), F.size(idx) - 1), lambda i: (i == 0) | (F.get(idx, i) != F.get(idx, i - 1)))).otherwise(F.array().cast("array<int>")))
    starts = F.col(t("starts"))
    share = lambda st: F.get(q, F.get(idx, st).cast("int"))
    pairs = F.transform(starts, lambda st, j: F.struct(((F.coalesce(F.get(starts, j + 1), F.size(idx)) - st) / n).alias("p"), share(st).alias("q")))
    there = _sum(F.transform(pairs, lambda x: _js_terms(x["p"], x["q"])))
    unseen = F.lit(1.0) - F.get(q, F.lit(0)) - _sum(F.transform(starts, share))
    divergence = there + _js_terms((n - F.size(idx)) / n, F.get(q, F.lit(0))) + 0.5 * F.greatest(F.lit(0.0), unseen)
    listed_share, unlisted = F.size(idx) / n, F.get(q, F.lit(0))
    absence = _distance(_js_terms(F.lit(1.0) - listed_share, unlisted) + _js_terms(listed_share, F.lit(1.0) - unlisted))
    absent = F.when((n >= rules.min_words) & (listed_share < F.lit(1.0) - unlisted), absence > rules.max_absence_distance)
    df = df.withColumns({"word_distance": F.when(n >= rules.min_words, _distance(divergence)), t("absent"): F.coalesce(absent, F.lit(False))})
    apart = F.col(t("absent")) | F.coalesce(F.col("char_distance") > rules.max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > rules.max_word_distance, F.lit(False))
    return drop_tmp(fenced(df.withColumn("kept", ~F.col("base_failed") & ~apart), ["base_failed", "char_distance", "word_distance", "kept"]))


def op1(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
