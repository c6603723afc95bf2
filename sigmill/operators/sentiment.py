"""Lexicon sentiment: rule-based polarity of short texts (the published VADER rules), by words, boosters, negations and marks.

The lexicon is a frame (word, valence); the rules' constants are those of the paper. Without its lexicon of 7,500 words, which isn't public
data of this project, any table of valences serves; the registered queries use a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.operators.trajectory import sentiment_class

# The rules' constants (Hutto and Gilbert 2014).
BOOST, CAPS, NEGATED, NORM = 0.293, 0.733, -0.74, 15.0
DAMPED = (1.0, 0.95, 0.9)
BOOSTERS = ("absolutely", "amazingly", "completely", "deeply", "especially", "extremely", "highly", "incredibly", "more", "most", "really", "remarkably", "so", "totally", "utterly", "very")
DAMPENERS = ("almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat")
NEGATIONS = ("aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent", "isnt", "neither", "never", "no", "none", "nope", "nor", "not", "nothing", "nowhere", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt")


def _with_lexicon(rows: DataFrame, key: str, lexicon: DataFrame, most: int) -> DataFrame:
    """``rows`` (key, _l, the lower-case words) with _lexicon, a map that holds the valences of their words: the whole lexicon beside every row if it has ``most`` words
    or fewer, else each text's own words, met by equality. Of a word's valences the largest counts."""
    known = lexicon.where("word is not null").groupBy(F.lower("word").alias("_word")).agg(F.max(F.col("valence").cast("double")).alias("_valence"))
    entries = F.map_from_entries(F.collect_list(F.struct("_word", "_valence")))
    if known.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(known.agg(entries.alias("_lexicon"))))  # one row
    own = rows.select(F.col(key).alias("_of"), F.explode("_l").alias("_word")).distinct().join(known, "_word").groupBy("_of").agg(entries.alias("_lexicon"))
    none = F.create_map().cast("map<string, double>")
    return rows.join(own, F.col(key).eqNullSafe(F.col("_of")), "left").withColumn("_lexicon", F.coalesce("_lexicon", none)).drop("_of")


def polarity(texts: DataFrame, key: str, text: str, lexicon: DataFrame, most: int = 20_000) -> DataFrame:
    """(key, neg, neu, pos, compound, label) of each row; blank texts are neutral. The lexicon (word, valence) may have any size.

    A word's valence is strengthened by capitals among other writing, by boosters and dampeners up to three words before it, and turned by
    negations there; a "but" halves what stands before it and raises what follows; exclamation and question marks strengthen the whole."""
    rows = texts.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    raw = F.filter(F.split("_t", r"\s+"), lambda w: w != "")
    plain = F.transform(raw, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    rows = rows.withColumn("_w", F.filter(plain, lambda w: F.length(w) > 1))
    shouted = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    rows = rows.withColumn("_mixed", F.exists("_w", shouted) & F.exists("_w", lambda w: ~shouted(w))).withColumn("_l", F.transform("_w", lambda w: F.lower(F.replace(w, F.lit("'"), F.lit("")))))
    rows = _with_lexicon(rows.withColumn("_but", F.array_position("_l", "but")), key, lexicon, most)
    low = lambda i, back: F.coalesce(F.get("_l", i - back), F.lit(""))
    up = lambda i, back: F.coalesce(F.get("_w", i - back), F.lit(""))

    def valence(w: Column, i: Column) -> Column:
        v = F.coalesce(F.try_element_at("_lexicon", w), F.lit(0.0))
        sign = F.signum(v)
        out = v + F.when(F.col("_mixed") & shouted(F.get("_w", i)), sign * CAPS).otherwise(0.0)
        for back in (1, 2, 3):
            step = F.when(low(i, back).isin(*BOOSTERS), BOOST).when(low(i, back).isin(*DAMPENERS), -BOOST).otherwise(0.0)
            step = step + F.when((step != 0) & F.col("_mixed") & shouted(up(i, back)), F.signum(step) * CAPS).otherwise(0.0)
            out = out + sign * step * DAMPED[back - 1]
        turned = F.lit(False)
        for back in (1, 2, 3):
            turned = turned | low(i, back).isin(*NEGATIONS)
        out = out * F.when(turned, NEGATED).otherwise(1.0)
        place = i + 1
        weight = F.when((F.col("_but") > 0) & (place < F.col("_but")), 0.5).when((F.col("_but") > 0) & (place > F.col("_but")), 1.5).otherwise(1.0)
        is_booster = w.isin(*BOOSTERS, *DAMPENERS)
        return F.when(is_booster | (v == 0), 0.0).otherwise(out * weight)

    rows = rows.withColumn("_v", F.transform("_l", valence))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    marks = lambda p: F.length("_t") - F.length(F.replace("_t", F.lit(p), F.lit("")))
    shout = F.least(marks("!"), F.lit(4)) * 0.292
    ask = F.when(marks("?") > 3, 0.96).when(marks("?") > 1, marks("?") * 0.18).otherwise(0.0)
    rows = rows.withColumn("_e", shout + ask).withColumn("_sum", total("_v"))
    whole = F.col("_sum") + F.signum("_sum") * F.col("_e")
    rows = rows.withColumn("compound", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), whole / F.sqrt(whole * whole + NORM))), 4))
    side = lambda keep, one: total(F.transform(F.filter("_v", keep), lambda x: x + one))
    rows = rows.withColumn("_p", side(lambda x: x > 0, 1)).withColumn("_n", side(lambda x: x < 0, -1)).withColumn("_z", F.size(F.filter("_v", lambda x: x == 0)).cast("double"))
    stronger = F.when(F.col("_p") > -F.col("_n"), F.struct((F.col("_p") + F.col("_e")).alias("p"), F.col("_n").alias("n"))).when(F.col("_p") < -F.col("_n"), F.struct(F.col("_p").alias("p"), (F.col("_n") - F.col("_e")).alias("n"))).otherwise(F.struct(F.col("_p").alias("p"), F.col("_n").alias("n")))
    rows = rows.withColumn("_s", stronger).withColumn("_all", F.col("_s.p") - F.col("_s.n") + F.col("_z"))
    share = lambda c, none: F.when(F.col("_all") > 0, F.round(F.abs(c / F.col("_all")), 3)).otherwise(none)
    return rows.select(key, share(F.col("_s.n"), 0.0).alias("neg"), share(F.col("_z"), 1.0).alias("neu"), share(F.col("_s.p"), 0.0).alias("pos"), F.coalesce("compound", F.lit(0.0)).alias("compound"), sentiment_class(F.coalesce("compound", F.lit(0.0))).alias("label"))
