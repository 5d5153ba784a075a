"""Quality rules by distribution divergence, in Spark expressions only.

A document's histograms of character classes and of common words are compared to
its language's by Jensen-Shannon distance (square root of the divergence in bits,
0 to 1). The references come from all documents: the common words of a language
are candidates of a mergeable frequent-items sketch, ranked by exact counts. The
sketch tracks ``TRACKED`` words in a map of 32,768 places, so it misjudges a count
by 3.5 / 32,768 of all words at most: a word can fall out of the ``CANDIDATES``
only if its share of a language's words is less than 0.011 % above that of the
least candidate.

A document fails if its class distance exceeds ``max_class_distance`` or its
common-word distance exceeds ``word_limit``; each verdict holds only for
documents of ``min_words`` words or more, as short texts scatter. Base rules come
first: fewer than 20 words, or over 30 % of words in repeated 8-word windows.

``word_limit`` is ``max_word_distance`` or, if less, ``lacking_fraction`` of the
distance that a document without any common word of its language has. The latter
holds only where a text as long would lack them all by chance less often than
``max_chance``, and not against the reference of all documents, whose common words
a language of its own may well lack.

Cases: null text counts as empty; documents without a language, or of one with
fewer than ``min_reference_words`` words, are compared to all documents together;
a null id is kept as it is; rows with equal ids or texts are judged one by one; of
words equally frequent the first in byte order is the more common; a text of any
length is measured whole; an empty table gives an empty result; columns other than
id, text and language are not looked at, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, functions as F

from .session import cut

_SPACES = r"[ \t\n\x0B\f\r]+"
#: Classes by their pattern; what no pattern takes is the last class.
CLASSES = {"digit": r"[0-9]", "upper": r"\p{Lu}", "mark": r"[\p{P}\p{S}]", "beyond_ascii": r"(?![\p{Lu}\p{P}\p{S}])[^\x00-\x7F]"}
CANDIDATES, COMMON, TRACKED = 32, 16, 20_000


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACES), "")


def _repeat_words(ws: Column) -> Column:
    """Words in 8-word windows that occur twice or more."""
    def twins(s: Column) -> Column:
        """Places i, ascending, of the structs (g, i) whose g is another one's too."""
        same = lambda x, k: (F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"])
        return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(F.when(k > 0, same(x, k)).otherwise(F.get(s, k + 1)["g"] == x["g"]), F.lit(False)) | F.coalesce((k > 0) & (F.get(s, k - 1)["g"] == x["g"]), F.lit(False))), lambda x: x["i"]))

    def exact(places: Column) -> Column:
        """The words that the windows at places cover which are equal to another one."""
        grams = F.sort_array(F.transform(places, lambda i: F.struct(F.array_join(F.slice(ws, i, F.lit(8)), " ").alias("g"), i.alias("i"))))
        steps = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(p, k + 1), x + 8) - x)), F.lit(0), lambda a, b: a + b)
        return _let(_let(grams, twins), steps)

    def twice(h: Column, k: int) -> Column:
        """Hashes of 2k items from those of k."""
        return _let(h, lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - k), F.slice(h, F.lit(k + 1), F.size(h) - k), lambda a, b: F.xxhash64(a, b)))

    hashes = twice(twice(twice(F.transform(ws, lambda w: F.xxhash64(w)), 1), 2), 4)
    numbered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("g"), (i + 1).alias("i"))))
    # equal windows have equal hashes; only those with a hash of another are compared as text
    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(_let(numbered(h), twins), exact)).otherwise(F.lit(0)))
    return F.when(F.size(ws) < 9, F.lit(0)).otherwise(found).cast("long")


def text_measures(docs: DataFrame, text: Column) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes (counts)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    # most characters are in no class and no symbol: without them the rest is counted faster
    rare = F.col("_rare")
    counts = [F.regexp_count(rare, F.lit(p)) for p in CLASSES.values()]
    ws = F.col("_ws")
    out = docs.withColumns({"_ws": _words(t), "_rare": F.translate(t, ascii_lowercase + " \t\n\x0B\f\r", "")}).withColumns({
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": F.regexp_count(rare, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(ws),
        "classes": F.array(*counts),
    })
    rest = F.col("word_chars") - F.aggregate("classes", F.lit(0), lambda a, b: a + b)
    return out.withColumn("classes", F.transform(F.concat("classes", F.array(rest.cast("int"))), lambda x: x.cast("double"))).drop("_ws", "_rare")


def _candidate_words(docs: DataFrame, min_reference_words: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words) of each language with a reference of its own, and the one row (pooled, pooled_counts) of all documents."""
    found = docs.select("lang", F.explode(_words(F.lower(F.coalesce("text", F.lit(""))))).alias("w"))
    tops = cut(found.groupBy("lang").agg(F.expr(f"approx_top_k(w, {CANDIDATES}, {TRACKED})").alias("top"), F.count("*").alias("ref_words")))
    each = tops.where((F.col("lang").isNotNull()) & (F.col("ref_words") >= min_reference_words)).select("lang", F.array_sort(F.transform("top", lambda x: x["item"])).alias("words"))
    item = tops.select(F.explode("top").alias("x")).groupBy("x.item").agg(F.sum("x.count").alias("n")).orderBy(F.desc("n"), "item").limit(CANDIDATES).select("item")
    exact = found.join(F.broadcast(item), F.col("w") == F.col("item")).groupBy("w").agg(F.count("*").cast("double").alias("n"))
    pooled = exact.agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("all"))
    return each, cut(pooled.select(F.col("all.w").alias("pooled"), F.col("all.n").alias("pooled_counts")))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: _let(total(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(share(p), share(q), lambda x, y: 0.5 * (part(x, (x + y) / 2) + part(y, (x + y) / 2)))
    return F.sqrt(F.greatest(total(terms), F.lit(0.0)))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, min_words: int = 50, max_class_distance: float = 0.3, max_word_distance: float = 0.4, min_reference_words: int = 10_000, lacking_fraction: float = 0.95, max_chance: float = 1e-3) -> DataFrame:
    """doc_id, the measures, base_failed, kept, both distances, word_limit, text_key (hash of the text); see the module's text."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    words, pooled = _candidate_words(own, min_reference_words)
    words = words.withColumnRenamed("lang", "known")
    named = own.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(words), own.lang == F.col("known"), "left").drop("known")
    counted = text_measures(named, F.col("text")).join(F.broadcast(pooled.select("pooled")), F.lit(True), "left")
    low = _words(F.lower(F.coalesce("text", F.lit(""))))
    few = lambda words: F.filter(low, lambda w: F.array_contains(words, w))
    tally = lambda words: _let(few(words), lambda ws: F.transform(words, lambda c: (F.size(ws) - F.size(F.array_remove(ws, c))).cast("double")))
    counted = counted.withColumn("counts", tally(F.coalesce("words", "pooled")))
    slim = cut(counted.select("doc_id", "text_key", "lang", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "counts"))
    return _judged(slim, pooled, min_words, max_class_distance, max_word_distance, lacking_fraction, max_chance)


def _judged(slim: DataFrame, pooled: DataFrame, min_words: int, max_class_distance: float, max_word_distance: float, lacking_fraction: float, max_chance: float) -> DataFrame:
    n_classes = len(CLASSES) + 1
    group = F.when(F.col("words").isNotNull(), F.col("lang"))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.coalesce(F.get("counts", F.lit(i)), F.lit(0.0))).alias(f"w{i}") for i in range(CANDIDATES)]
    totals = slim.groupBy(group.alias("ref_lang")).agg(F.sum("n_words").alias("ref_words"), *sums)
    classes = F.array(*[f"c{i}" for i in range(n_classes)])
    refs = totals.where("ref_lang is not null").select("ref_lang", "ref_words", classes.alias("ref_classes"), F.array(*[f"w{i}" for i in range(CANDIDATES)]).alias("ref_counts"))
    everyone = totals.agg(F.sum("ref_words").alias("ref_words"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(n_classes)])
    refs = refs.unionByName(everyone.join(F.broadcast(pooled), F.lit(True)).select(F.lit(None).cast("string").alias("ref_lang"), "ref_words", classes.alias("ref_classes"), F.col("pooled_counts").alias("ref_counts")))
    rank = F.array_sort(F.transform("ref_counts", lambda x, i: F.struct((-x).alias("n"), i.alias("i"))))
    refs = refs.withColumn("picked", F.transform(F.slice(rank, 1, COMMON), lambda x: x["i"]))
    pick = lambda counts, n: _let(F.transform("picked", lambda i: F.coalesce(F.get(counts, i), F.lit(0.0))), lambda a: F.concat(a, F.array(F.greatest(n - F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))))
    refs = refs.withColumn("ref_picked", pick(F.col("ref_counts"), F.col("ref_words").cast("double")))
    lacking = F.concat(F.transform("picked", lambda i: F.lit(0.0)), F.array(F.lit(1.0)))
    refs = refs.withColumns({"lacking": _distance(lacking, F.col("ref_picked")), "rest": F.try_divide(F.element_at("ref_picked", -1), F.col("ref_words"))})
    got = slim.join(F.broadcast(refs), group.eqNullSafe(F.col("ref_lang")), "left")
    telling = F.col("ref_lang").isNotNull() & (F.pow("rest", F.col("n_words").cast("double")) < max_chance)
    out = got.withColumns({
        "class_distance": _distance(F.col("classes"), F.col("ref_classes")),
        "word_distance": _distance(pick(F.col("counts"), F.col("n_words").cast("double")), F.col("ref_picked")),
        "word_limit": F.when(telling, F.least(F.lit(max_word_distance), lacking_fraction * F.col("lacking"))).otherwise(F.lit(max_word_distance)),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    })
    off = (F.col("n_words") >= min_words) & ((F.col("class_distance") > max_class_distance) | (F.col("word_distance") > F.col("word_limit")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~off).alias("kept"), "class_distance", "word_distance", "word_limit", "text_key")


def op7_divergence_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


SQL = None
