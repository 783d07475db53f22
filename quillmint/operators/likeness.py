"""Lines that say nearly the same: a weighted similarity join over words, and the ratio of two texts' common blocks.

Two words are alike where they are equal (100), one keystroke apart (80) or one begins the other (75). A line's likeness to
another is what their words have in common over what they have together: equal words meet first, each counting the smaller
of its two weights; of the rest a pair counts, in part, where each word is the other's best. Weights are whole numbers, so
sums and ties are exact.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillmint.operators.joins import deletion_variants, one_keystroke
from quillmint.sources.settled import settled

EQUAL, KEYSTROKE, BEGINS = 100, 80, 75
LEAST_KEYSTROKE, LEAST_BEGIN = 5, 3  # letters of either word, letters of the shorter one
FILLERS = ("and", "for", "from", "per", "the", "with")


def line_words(x: Column) -> Column:
    """The different words of a description that tell what was bought: three or more characters, a letter among them, without a plural s and filler words."""
    words = F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & w.rlike("[a-z]") & ~w.isin(*FILLERS))
    single = lambda w: F.when((F.length(w) >= 5) & w.rlike("[^s]s$"), F.substring(w, 1, F.length(w) - 1)).otherwise(w)
    return F.array_sort(F.array_distinct(F.transform(words, single)))


def alike_words(words: DataFrame) -> DataFrame:
    """Different words (column word) that are alike: a, b and by how much, both ways round.

    Words one keystroke apart share a variant with a character less, words that begin others are joined to their
    beginnings: both are joins on equal keys.
    """
    w = words.select("word").distinct().where("word is not null")
    letters = ~F.col("word").rlike("[0-9]")
    variants = w.where(letters & (F.length("word") >= LEAST_KEYSTROKE)).select("word", F.explode(deletion_variants(F.col("word"))).alias("v"))
    near = variants.select("v", F.col("word").alias("a")).join(variants.select("v", F.col("word").alias("b")), "v").where("a < b").select("a", "b").distinct()
    near = near.where(one_keystroke(F.col("a"), F.col("b"))).select("a", "b", F.lit(KEYSTROKE).alias("like"))
    cut = F.transform(F.sequence(F.lit(LEAST_BEGIN), F.length("word") - 1), lambda n: F.substring(F.col("word"), 1, n))
    longer = w.where(letters & (F.length("word") > LEAST_BEGIN)).select(F.col("word").alias("b"), F.explode(cut).alias("a"))
    begins = longer.join(w.where(letters).select(F.col("word").alias("a")), "a").select("a", "b", F.lit(BEGINS).alias("like"))
    one_way = near.unionByName(begins)
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "like"))
    return both.groupBy("a", "b").agg(F.max("like").alias("like"))


def similar_pairs(lines: DataFrame, least: float, measure: bool = False) -> DataFrame:
    """Pairs of ids (a < b) with a likeness of at least ``least`` (to three places): common (in hundredths of weights), together, similarity.

    ``lines`` has id and words, an array of (word, weight). A pair that is this alike has in common at least the
    share ``least`` of either line's weight, so a word of the first line's beginning, its rarest words up to that
    share, is alike to one of the second. The pairs proposed so must also have sizes within that share of each other,
    and what the first line still has from its first such word on must suffice. With ``measure`` the candidates are
    returned with their number of common words in place of the scores.
    """
    share = round(least * 1000)
    each = settled(lines.select("id", F.explode("words").alias("x")).select("id", "x.word", F.col("x.weight").cast("long").alias("weight")))
    held = each.groupBy("word").agg(F.count("*").alias("lines"))
    rare_first = Window.partitionBy("id").orderBy("lines", "word")
    ranked = each.join(held, "word").withColumns({
        "whole": F.sum("weight").over(Window.partitionBy("id")), "rest": F.sum("weight").over(rare_first.rowsBetween(0, Window.unboundedFollowing)),
    })
    alike = settled(alike_words(each).unionByName(each.select(F.col("word").alias("a"), F.col("word").alias("b"), F.lit(EQUAL).alias("like")).distinct()))
    first = ranked.where(F.col("rest") * 1000 >= F.col("whole") * share).select(F.col("id").alias("a_id"), F.col("word").alias("a"), F.col("whole").alias("a_whole"), "rest")
    second = ranked.select(F.col("id").alias("b_id"), F.col("word").alias("b"), F.col("whole").alias("b_whole"))
    sized = (F.col("a_whole") * 1000 >= F.col("b_whole") * share) & (F.col("b_whole") * 1000 >= F.col("a_whole") * share)
    met = first.join(alike.drop("like"), "a").join(second, "b").where((F.col("a_id") < F.col("b_id")) & sized)
    found = met.groupBy("a_id", "b_id", "a_whole", "b_whole").agg(F.max("rest").alias("rest"), F.count("*").alias("met"))
    found = found.where(F.col("rest") * (1000 + share) >= (F.col("a_whole") + F.col("b_whole")) * share)
    if measure:
        return found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "met")
    pair = ["a_id", "b_id"]
    whole = ["a_whole", "b_whole"]
    ours = found.drop("rest", "met").join(each.select(F.col("id").alias("a_id"), F.col("word").alias("a"), F.col("weight").alias("wa")), "a_id")
    theirs = each.select(F.col("id").alias("b_id"), F.col("word").alias("b"), F.col("weight").alias("wb"))
    meets = ours.join(alike, "a").join(theirs, ["b_id", "b"]).withColumn("value", F.col("like") * F.least("wa", "wb"))
    of_a, of_b, same = Window.partitionBy(*pair, "a"), Window.partitionBy(*pair, "b"), F.col("a") == F.col("b")
    free = meets.withColumns({"met_a": F.max(same).over(of_a), "met_b": F.max(same).over(of_b)}).where(same | ~F.col("met_a") & ~F.col("met_b"))
    ranked = {"na": F.row_number().over(of_a.orderBy(F.desc("value"), "b")), "nb": F.row_number().over(of_b.orderBy(F.desc("value"), "a"))}
    scored = free.withColumns(ranked).where("na = 1 and nb = 1").groupBy(*pair, *whole).agg(F.sum("value").alias("common"))
    together = (F.col("a_whole") + F.col("b_whole")) * EQUAL - F.col("common")
    scored = scored.withColumn("together", together).withColumn("similarity", F.round(F.col("common") / F.col("together"), 6))
    return scored.where(F.col("common") * 1000 >= F.col("together") * share).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "common", "together", "similarity")


def similar_pairs_sql(lines: str, least: float) -> str:
    """The same pairs by comparing all lines; ``lines`` is SQL with id and words, a list of (word, weight) structs."""
    like = (
        f"case when x.word = y.word then {EQUAL} when regexp_matches(x.word || y.word, '[0-9]') then 0 "
        f"when least(len(x.word), len(y.word)) >= {LEAST_KEYSTROKE} and damerau_levenshtein(x.word, y.word) = 1 then {KEYSTROKE} "
        f"when least(len(x.word), len(y.word)) >= {LEAST_BEGIN} and (starts_with(x.word, y.word) or starts_with(y.word, x.word)) then {BEGINS} else 0 end"
    )
    return f"""(with sp_l as ({lines}), sp_w as (select id, unnest(words, recursive := true) from sp_l), sp_s as (select id, sum(weight) as whole from sp_w group by 1),
    sp_m as (select x.id as a_id, y.id as b_id, x.word as a, y.word as b, {like} as lk, {like} * least(x.weight, y.weight) as value from sp_w x join sp_w y on x.id < y.id),
    sp_e as (select * from sp_m where a = b),
    sp_r as (select *, row_number() over (partition by a_id, b_id, a order by value desc, b) as na, row_number() over (partition by a_id, b_id, b order by value desc, a) as nb
      from sp_m anti join sp_e using (a_id, b_id, a) where lk > 0 and not exists (select 1 from sp_e e where e.a_id = sp_m.a_id and e.b_id = sp_m.b_id and e.b = sp_m.b)),
    sp_c as (select a_id, b_id, sum(value) as common from (select a_id, b_id, value from sp_e union all select a_id, b_id, value from sp_r where na = 1 and nb = 1) group by 1, 2),
    sp_t as (select a_id as a, b_id as b, common, (p.whole + q.whole) * {EQUAL} - common as together from sp_c join sp_s p on p.id = a_id join sp_s q on q.id = b_id)
    select a, b, cast(common as bigint) as common, cast(together as bigint) as together, round(common::double / together::double, 6) as similarity from sp_t where common * 1000 >= {round(least * 1000)} * together)"""


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of two texts' longest common blocks, found again on either side of each, over both lengths.

    A batch compares each pair of texts once; null counts as empty, and two empty texts are equal.
    """
    pairs = pd.DataFrame({"a": a.fillna(""), "b": b.fillna("")})
    known = {}
    for x, group in pairs.drop_duplicates().groupby("b", sort=False):
        matcher = SequenceMatcher(None, autojunk=False)
        matcher.set_seq2(x)  # what it learns of the second text serves all of the first
        for y in group["a"]:
            matcher.set_seq1(y)
            known[y, x] = matcher.ratio()
    return pd.Series([known[x] for x in zip(pairs["a"], pairs["b"], strict=True)], dtype="float64")
