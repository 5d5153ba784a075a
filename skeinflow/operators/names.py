"""Names of taxa: folded, matched, and followed through synonyms to an accepted key."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.lineage import cut

#: Latin letters with marks and what is left of them.
_MARKED = {chr(c): base for c in range(0xC0, 0x250) if len(base := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c)}


def folded(name: Column) -> Column:
    """Lower case without marks on Latin letters and without apostrophes; other signs are one space between words; null if nothing is left."""
    plain = F.translate(F.lower(F.translate(name, "".join(_MARKED), "".join(_MARKED.values()))), "'\u2019\u2018`", "")
    return F.nullif(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def accepted_keys(backbone: DataFrame) -> DataFrame:
    """(key, root, status) of each key of backbone (key, accepted_key): the end of its chain of synonyms.

    A key without an accepted_key, or that names itself, is accepted. Each round doubles
    the steps that every key has gone, so chains take the logarithm of their length; keys
    left when a round settles none go in circles. A chain that leaves the backbone is
    broken. Both have a null root. A key that stands there twice must say the same
    twice, else it is broken too.
    """
    each = backbone.where("key is not null").groupBy("key").agg(F.min(F.coalesce("accepted_key", "key")).alias("to"), F.max(F.coalesce("accepted_key", "key")).alias("also"))
    # a step to null: out of the backbone
    d = each.select("key", F.when(F.col("to") == F.col("also"), F.col("to")).alias("to"))
    d = d.join(d.select(F.col("key").alias("to"), F.lit(True).alias("known")), "to", "left").select("key", F.when(F.col("known"), F.col("to")).alias("to"))
    d = cut(d)
    ends = d.where("key = to").select(F.col("key").alias("end"))  # only these: a circle comes back to itself later
    before = None
    while True:
        d = cut(d.join(ends, F.col("to") == F.col("end"), "left").select("key", "to", (F.col("end").isNotNull() | F.col("to").isNull()).alias("root")))
        left = d.where("not root").count()
        if left in (0, before):
            break
        before = left
        onward = d.select(F.col("key").alias("at"), F.col("to").alias("next"))
        d = d.join(onward, F.col("to") == F.col("at"), "left").select("key", F.when(F.col("root"), F.col("to")).otherwise(F.col("next")).alias("to"))
    status = F.when(~F.col("root"), "circle").when(F.col("to").isNull(), "broken").when(F.col("key") == F.col("to"), "accepted").otherwise("synonym")
    return d.select("key", F.when(F.col("root"), F.col("to")).alias("root"), status.alias("status"))


def resolved(names: DataFrame, backbone: DataFrame, name: str, *, least_confidence: int = 0) -> DataFrame:
    """names with accepted_key and refusal: null, or why the name has no key.

    backbone: key, name, accepted_key, confidence. Names match when folded; entries below
    least_confidence don't count. Entries of one name that lead to one key are one match,
    to several: ambiguous.
    """
    roots = accepted_keys(backbone.select("key", "accepted_key"))
    sure = backbone.where(F.coalesce("confidence", F.lit(0)) >= least_confidence).select("key", folded(F.col("name")).alias("_folded")).where("_folded is not null")
    found = sure.join(roots, "key").groupBy("_folded").agg(F.min("root").alias("_root"), F.max("root").alias("_other"), F.max(F.when(F.col("root").isNull(), F.col("status"))).alias("_status"))
    d = names.withColumn("_folded", folded(F.col(name))).join(found, "_folded", "left")
    refusal = F.when(F.col("_folded").isNull(), "no name").when(F.col("_root").isNull() & F.col("_status").isNull(), "unknown").when(F.col("_root").isNull(), F.col("_status")).when(F.col("_root") != F.col("_other"), "ambiguous")
    return d.withColumns({"accepted_key": F.when(refusal.isNull(), F.col("_root")), "refusal": refusal}).drop("_folded", "_root", "_other", "_status")
