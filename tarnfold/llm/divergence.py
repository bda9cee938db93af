"""Quality rules: base counts, and distance from the language's usual distributions.

Two histograms are compared with references by the Jensen-Shannon distance (base 2, 0 to 1):
classes of characters, and common words of the document's language against all others. A
reference is the sum of the histograms of all documents of a language, so it covers the
whole corpus; references are broadcast only if they are counted few. Languages without
fixed common words take their most frequent letter runs in the corpus.
Guards: histograms of fewer than `least_chars` characters or `least_words` letter runs are
not judged; documents without lang are held, by characters only, against their own sum, and
only if it fits most of them.

Edge cases: a null text has no words; null doc_ids and repeated rows are judged like any other; texts of any length are judged whole; the
columns of the input travel in one struct, so no name can clash; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

# Common words by language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "nicht", "für", "ein", "auf", "dem", "im"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "on", "be", "by", "this", "are"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
# Classes of characters, each taken from what the ones before left.
SYMBOLS = r"[#*$%&|<>]+"
CLASSES = (r"[a-z]+", r"[A-Z]+", SYMBOLS, r"[0-9]+", r"""[.,;:!?'"()-]+""", r"\p{L}+")
LETTER_RUN = "[^a-zß-öø-ÿ]+"
#: Letter runs of languages without fixed common words; combining marks belong to them.
ANY_LETTER_RUN = r"[^\p{L}\p{M}]+"
#: So many references are broadcast (about 250 bytes each); more are joined by shuffle.
BROADCAST_REFERENCES = 10_000
#: Share of the judged documents without lang that their sum must fit to be a reference.
LEAST_FITTING = 0.5

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.34, 0.34
LEAST_CHARS, LEAST_RUNS = 200, 80


def let(value: Column, body) -> Column:
    """Evaluates value once for all its uses in body."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more."""

    def covered(found: Column) -> Column:
        twice = F.filter(found, lambda x, j: (F.get(found, j - 1)["h"] == x["h"]) | (F.get(found, j + 1)["h"] == x["h"]))
        begun = F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, s: F.struct(s.alias("at"), (acc["n"] + F.least(F.lit(window), s - acc["at"])).alias("n"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["at"])), begun, step, lambda acc: acc["n"])

    def of_windows(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(placed, covered))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(window)]))
        return F.when(F.size(h) <= window, F.lit(0)).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def class_counts(text: Column) -> Column:
    """Characters of each class in CLASSES and of none, white space left out."""

    def counts(left: Column, classes, so_far) -> Column:
        if not classes:
            return F.array(*so_far, F.char_length(left))
        return let(F.regexp_replace(left, classes[0], ""), lambda rest: counts(rest, classes[1:], [*so_far, F.char_length(left) - F.char_length(rest)]))

    return let(F.regexp_replace(text, common.SPACE, ""), lambda solid: counts(solid, CLASSES, []))


def listed_lang(lang: Column) -> Column:
    return lang.isin(*COMMON_WORDS)


def runs_of(text: Column, lang: Column) -> Column:
    """The letter runs of a text, lower-cased; in languages without fixed common words of any script."""
    low = F.lower(text)
    return F.array_remove(F.when(listed_lang(lang), F.split(low, LETTER_RUN)).otherwise(F.split(low, ANY_LETTER_RUN)), "")


def corpus_words(docs: DataFrame) -> DataFrame | None:
    """(lang, words, docs): the most frequent letter runs of each language without fixed ones; None if there is none."""
    others = docs.select("lang", "text").where(F.col("lang").isNotNull() & ~listed_lang(F.col("lang")))
    if others.isEmpty():
        return None
    n = len(next(iter(COMMON_WORDS.values())))
    each = others.select("lang", F.explode(runs_of(common.text_or_empty(), F.col("lang"))).alias("word"))
    counts = each.groupBy("lang", "word").agg(F.count("*").alias("times"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("times"), "word"))
    words = counts.withColumn("place", first).where(F.col("place") <= n).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word")))["word"].alias("words"))
    rows = others.groupBy("lang").agg(F.count("*").alias("docs"))
    return common.stored(rows.join(words, "lang", "left").select("lang", F.coalesce("words", F.array().cast("array<string>")).alias("words"), "docs"), "op6-words")


def with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """rows LEFT JOIN facts on key: broadcast only if counted small, else with hot keys dealt out."""
    if facts.count() <= BROADCAST_REFERENCES:
        return rows.join(F.broadcast(facts.drop(count)), key, "left")
    return common.join_on_hot_key(rows, facts, key, count, F.coalesce("row.doc_id", F.lit(0)))


def word_counts(text: Column, lang: Column, derived: Column) -> Column:
    """Letter runs that are the language's k-th common word, and the others; null without common words."""
    listed = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    n = len(next(iter(COMMON_WORDS.values())))

    def counted(words: Column, hits_of) -> Column:
        def of(runs: Column) -> Column:
            def split(hits: Column) -> Column:
                each = [F.size(hits) - F.size(F.array_remove(hits, F.coalesce(F.get(words, F.lit(k)), F.lit("")))) for k in range(n)]
                return let(F.array(*each), lambda e: F.concat(e, F.array(F.size(runs) - F.aggregate(e, F.lit(0), lambda a, x: a + x))))

            return let(hits_of(runs), split)

        return of

    runs = runs_of(text, lang)
    fixed = let(runs, counted(F.element_at(listed, lang), lambda r: F.filter(r, lambda w: w.isin(every))))
    own = let(runs, counted(derived, lambda r: F.filter(r, lambda w: F.array_contains(derived, w))))
    return F.when(listed_lang(lang), fixed).when(F.size(derived) > 0, own)


def measured(docs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> (row, q): the struct of its columns; profile, both histograms and base counts."""
    text, lang = common.text_or_empty("row.text"), F.col("row.lang")
    rows = common.packed(docs)
    derived = F.lit(None).cast("array<string>")
    if words is not None:
        rows = with_facts(rows.withColumn("lang", lang), words, "lang", "docs")
        derived = F.col("words")
    profile = F.when(lang.isNotNull(), F.concat(F.lit("="), lang)).otherwise(F.lit("*"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = let(common.words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    twice = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    found = (profile.alias("profile"), class_counts(text).cast("array<long>").alias("chars"), word_counts(text, lang, derived).cast("array<long>").alias("common"))
    return rows.select("row", F.struct(*found, base.alias("words"), twice.alias("n_dup_lines")).alias("q"))


def references(found: DataFrame) -> DataFrame:
    """One row a profile with the summed histograms of all its documents."""
    n_words = len(next(iter(COMMON_WORDS.values()))) + 1
    total = lambda name, n: F.array(*[F.coalesce(F.sum(F.col(f"q.{name}")[i]), F.lit(0)) for i in range(n)])
    sums = [total("chars", len(CLASSES) + 1).alias("_chars"), total("common", n_words).alias("_common"), F.count("*").alias("_docs")]
    return found.groupBy(F.col("q.profile").alias("_profile")).agg(*sums)


def coherent(refs: DataFrame, found: DataFrame) -> DataFrame:
    """refs without the one of documents that have no lang, where it does not fit most of them."""
    pool = refs.where("_profile = '*'")
    if pool.isEmpty():
        return refs
    chars = F.col("q.chars")
    apart = found.where(F.col("q.profile") == "*").where(total_of(chars) >= LEAST_CHARS).crossJoin(F.broadcast(pool.select("_chars")))
    fits = apart.agg(F.avg((distance(chars, F.col("_chars")) <= MOST_CHAR_DISTANCE).cast("int"))).first()[0]
    return refs if fits is None or fits > LEAST_FITTING else refs.where("_profile <> '*'")


def total_of(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts, neither empty."""

    def shares(c: Column) -> Column:
        return let(total_of(c), lambda n: F.transform(c, lambda x: x / n))

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    each = F.zip_with(shares(counts), shares(reference), lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2))


def judged(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds to `q` the distances (null: not judged), base_failed and kept."""
    n_words, repeated = F.col("q.words.n_words"), F.col("q.words.n_repeat_words")
    chars, own = F.col("q.chars"), F.col("q.common")
    with_refs = with_facts(found.withColumn("_profile", F.col("q.profile")), refs, "_profile", "_docs")
    by_char = F.when(F.col("_chars").isNotNull() & (total_of(chars) >= LEAST_CHARS), distance(chars, F.col("_chars")))
    by_word = F.when(own.isNotNull() & (total_of(own) >= LEAST_RUNS), distance(own, F.col("_common")))
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    scored = with_refs.withColumn("q", F.col("q").withField("char_distance", by_char).withField("word_distance", by_word).withField("base_failed", failed))
    fits = (F.coalesce(F.col("q.char_distance"), F.lit(0.0)) <= MOST_CHAR_DISTANCE) & (F.coalesce(F.col("q.word_distance"), F.lit(0.0)) <= MOST_WORD_DISTANCE)
    return scored.withColumn("q", F.col("q").withField("kept", ~F.col("q.base_failed") & fits)).select("row", "q")


def judged_all(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> (row, q), held against references of all of docs; what is counted is stored once."""
    found = common.stored(measured(docs, corpus_words(docs)), "op6-counts")
    return judged(found, common.stored(coherent(common.stored(references(found), "op6-references"), found), "op6-fitting"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    found = judged_all(docs).where("q.kept")
    return found.select(*common.unpacked(found))


def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(sf_dir, "documents", spark).select("doc_id", "text", "lang")
    found = common.stored(measured(docs, corpus_words(docs)).select(F.struct("row.doc_id").alias("row"), "q"), "op6-counts")
    refs = coherent(common.stored(references(found), "op6-references"), found)
    return judged(found, refs).select(
        "row.doc_id",
        "q.words.n_words",
        total_of(F.col("q.chars")).alias("word_chars"),
        F.col("q.chars")[CLASSES.index(SYMBOLS)].alias("n_symbols"),
        "q.n_dup_lines",
        "q.words.n_repeat_words",
        "q.base_failed",
        "q.kept",
        F.round("q.char_distance", 6).alias("char_distance"),
        F.round("q.word_distance", 6).alias("word_distance"),
    )


def _steps() -> str:
    out, last = [], "solid"
    for i, c in enumerate(CLASSES):
        quoted = c.replace("'", "''")
        out.append(f"c{i} AS (SELECT *, regexp_replace({last}, '{quoted}', '', 'g') AS l{i} FROM {'solids' if not i else f'c{i - 1}'})")
        last = f"l{i}"
    return ",\n".join(out)


_CHARS = "[" + ", ".join(f"length({'solid' if not i else f'l{i - 1}'}) - length(l{i})" for i in range(len(CLASSES))) + f", length(l{len(CLASSES) - 1})]"
_LISTS = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items()) + "}"
_JS = """sqrt(greatest(0.0, list_sum(list_transform(range(1, len({a}) + 1), lambda i: {p} + {q})) / 2))"""


def _distance(a: str, b: str) -> str:
    p, q = f"({a}[i] / list_sum({a}))", f"({b}[i] / list_sum({b}))"
    half = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0.0 END"
    return _JS.format(a=a, p=half.format(x=p, y=q), q=half.format(x=q, y=p))


_N = len(next(iter(COMMON_WORDS.values())))
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, row_number() OVER () AS k FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
win AS (SELECT k, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) > {WINDOW}),
hashed AS (SELECT k, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s FROM win),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM hashed) WHERE c > 1),
spread AS (SELECT k, sum(least({WINDOW}, i - coalesce(p, -{WINDOW}))) AS n FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS p FROM twice) GROUP BY k),
solids AS (SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g') AS solid FROM d),
{_steps()},
h AS (SELECT k, {_CHARS} AS chars FROM c{len(CLASSES) - 1}),
runs AS (SELECT k, lang, list_filter(string_split_regex(lower(text), '{LETTER_RUN}'), lambda x: x <> '') AS r, {_LISTS} AS lists FROM d WHERE lang IN ({', '.join(repr(x) for x in COMMON_WORDS)})),
hits AS (SELECT k, len(r) AS n, list_transform(lists[lang], lambda v: len(list_filter(r, lambda x: x = v))) AS e FROM runs),
own AS (SELECT k, list_concat(e, [n - list_sum(e)]) AS common FROM hits),
every AS (SELECT d.*, chars, common, CASE WHEN common IS NULL THEN '*' ELSE lang END AS profile FROM d JOIN h USING (k) LEFT JOIN own USING (k)),
refs AS (SELECT profile, [{', '.join(f'sum(chars[{i + 1}])' for i in range(len(CLASSES) + 1))}] AS rc, [{', '.join(f'coalesce(sum(common[{i + 1}]), 0)' for i in range(_N + 1))}] AS rw FROM every GROUP BY 1),
scored AS (SELECT doc_id, len(words) AS n_words, list_sum(chars) AS word_chars, chars[{CLASSES.index(SYMBOLS) + 1}] AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
  coalesce(spread.n, 0) AS n_repeat_words,
  CASE WHEN list_sum(chars) >= {LEAST_CHARS} THEN {_distance("chars", "rc")} END AS cd,
  CASE WHEN common IS NOT NULL AND list_sum(common) >= {LEAST_RUNS} THEN {_distance("common", "rw")} END AS wd
  FROM every JOIN w USING (k) JOIN refs USING (profile) LEFT JOIN spread USING (k))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND coalesce(cd, 0) <= {MOST_CHAR_DISTANCE} AND coalesce(wd, 0) <= {MOST_WORD_DISTANCE} AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM scored
"""
