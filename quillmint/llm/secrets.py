"""Operator 4: secret scans with base patterns and character Markov models, in DataFrame expressions only.

Three base patterns find assignments, access keys and hexadecimal runs. A pair of first-order character models, one of
random strings and one of ordinary identifiers, is trained from labelled samples: generated digests are the random
ones, every run of identifier characters that no base pattern touches, of all documents, counts as an ordinary one.
An unbroken run of 16 or more characters that no base match touches is a secret too where the mean log-likelihood
ratio of its transitions exceeds a threshold calibrated on the same samples. The model is a table of 67 x 67 ratios.

Positions follow from splitting a text at the matches: the pieces' and matches' lengths add up to code points.

Defined results: a null or empty text has no spans; rows repeat as often as they come, null ids included; other
columns of the input are kept or left alone as asked; an empty table gives an empty table, whose model knows random
strings only and finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmint.llm.staging import stage, tidy

# The base patterns, their kinds in listed order, and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

RUN = r"[A-Za-z0-9+/_=-]{16,}"  # LEAST_RUN characters
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)
BACK_OFF, EVEN = 0.02, 0.001  # shares of the back-off to single characters, and of the even spread in that
GRAIN = 1000  # steps of a ratio in the histogram
ORDINARY_BELOW, RANDOM_BELOW = 0.999, 0.01
LEAST_RUN = 16  # characters of a run that the models judge
MOST_FITS, STABLE = 4, 0.01
CHUNK = 256  # matches that are placed together before the chunks are
SPAN = "struct<start:int,end:int,value:string>"
REDACTED = "<SECRET>"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>; value is the given group.

    Matches are placed within chunks and the chunks within the text, so that no step copies all matches before it.
    """
    p = F.lit(pattern)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("value")
    )
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def moved(x: Column, by: Column) -> Column:
        return F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["value"].alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        added = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), added.alias("out")))

    def chunks(z: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(z), F.lit(1)), F.lit(CHUNK))
        return F.transform(starts, lambda i: F.aggregate(F.slice(z, i, F.lit(CHUNK)), state, step))

    outer = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("out"))

    def placed(acc: Column, c: Column) -> Column:
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(c["out"], lambda x: moved(x, acc["at"])))).alias("out"))

    found = F.aggregate(_once(zipped, chunks), outer, placed, lambda acc: F.flatten(acc["out"]))
    return F.when(F.rlike(text, p), found).otherwise(none)


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the matches of each kind in the whole text: _assign, _access, _hex and the runs _run."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.filter(_spans(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)
    return docs.select(
        *keep, assign.alias("_assign"), _spans(text, ACCESS).alias("_access"), _spans(text, HEX).alias("_hex"), _spans(text, RUN).alias("_run")
    )


def labelled_samples(docs: DataFrame, text_col: str = "text", strings: int = 2000) -> DataFrame:
    """Labelled strings (value, label, n): random strings as 1, ordinary identifiers as 0, and how often they occur.

    Random: digests written in hexadecimal, in both cases of base 64 and in upper case with digits, ``strings`` of
    each. Ordinary: the runs of identifier characters of all documents without what the base patterns match. A run
    counts with a joint before and behind it, as identifiers join words.
    """
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.concat(F.lit("quillmint-"), F.col("id").cast("string")), 256))
    base = F.regexp_replace(F.base64(digest), "=", "")
    random = spark.range(strings).select(F.explode(F.array(F.lower(F.hex(digest)), base, F.upper(F.regexp_replace(base, "[+/]", "")))).alias("value"))
    random = random.select("value", F.lit(1).alias("label"), F.lit(1).cast("long").alias("n"))
    text = F.regexp_replace(F.regexp_replace(F.col(text_col).cast("string"), ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/_=-]+"), F.lit(0))).alias("word"))
    ordinary = words.groupBy("word").agg(F.count("*").alias("n")).select(F.concat(F.lit("_"), "word", F.lit("_")).alias("value"), F.lit(0).alias("label"), "n")
    return random.unionByName(ordinary)


def _ratio(table: Column, value: Column) -> Column:
    """Mean log-likelihood ratio of a string's transitions: random over ordinary."""
    letters = F.lit(ALPHABET)
    state = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("total"))

    def step(acc: Column, c: Column) -> Column:
        now = F.instr(letters, c)
        added = F.when(acc["before"] > 0, F.coalesce(F.get(table, (acc["before"] - 1) * SIZE + now - 1), F.lit(0.0))).otherwise(0.0)
        return F.struct(now.alias("before"), (acc["total"] + added).alias("total"))

    characters = F.regexp_extract_all(value, F.lit("."), F.lit(0))
    return F.aggregate(characters, state, step, lambda acc: acc["total"]) / (F.length(value) - 1)


def _ratios(counts: dict[tuple[int, str], int]) -> Column:
    """The table of log-likelihood ratios from counts of (label, transition)."""
    # Shares, not counts, smooth the transitions, so that ratios do not depend on how much text there is.
    share, totals = {}, {}
    for label in (0, 1):
        follows = {b: sum(counts.get((label, a + b), 0) for a in ALPHABET) for b in ALPHABET}
        whole = max(sum(follows.values()), 1)
        share |= {(label, b): (1 - EVEN) * n / whole + EVEN / SIZE for b, n in follows.items()}
        totals |= {(label, a): sum(counts.get((label, a + b), 0) for b in ALPHABET) for a in ALPHABET}

    def rate(label: int, a: str, b: str) -> float:
        seen = totals[label, a]
        own = counts.get((label, a + b), 0) / seen if seen else share[label, b]
        return (1 - BACK_OFF) * own + BACK_OFF * share[label, b]

    return F.lit([math.log(rate(1, a, b) / rate(0, a, b)) for a in ALPHABET for b in ALPHABET])


def _threshold(ordinary: list[tuple[int, int]], random: list[tuple[int, int]]) -> tuple[float, float]:
    """The threshold, and the ratio up to which a run of unknown kind is taken for ordinary.

    The runs are a mixture. Those below half of the random strings' first percentile are ordinary; the threshold is midway
    between their 99.9th percentile and that first one. So it is half to three quarters of that first percentile, however
    many of the runs are secrets.
    """
    least = _quantile(random, RANDOM_BELOW)
    below = [(step, n) for step, n in ordinary if step / GRAIN <= least / 2]
    return ((max(_quantile(below, ORDINARY_BELOW), 0.0) if below else 0.0) + least) / 2, least / 2


def train(samples: DataFrame) -> tuple[Column, float]:
    """The table of log-likelihood ratios as an array column, and the calibrated threshold.

    Words too short for a secret and plain numbers make the first model of ordinary text. Each further fit
    adds the long runs that the last one calls ordinary, until the threshold stays. Only counts of transitions, at most
    2 * 67 * 67 of them, and histograms reach the driver.
    """
    samples = stage(samples.where(F.length("value") >= 2), "secret-samples")
    short = (F.col("label") == 1) | (F.length("value") < LEAST_RUN + 2) | F.col("value").rlike("^_[0-9]+_$")  # an ordinary word has a joint on both sides
    runs = samples.where(F.length("value") >= F.when(F.col("label") == 1, LEAST_RUN).otherwise(LEAST_RUN + 2))

    def transitions(rows: DataFrame) -> dict[tuple[int, str], int]:
        pairs = rows.select("label", "n", F.explode(F.regexp_extract_all("value", F.lit("(?=(..))"), F.lit(1))).alias("pair"))
        return {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()}

    first = transitions(samples.where(short))
    if not any(label == 0 for label, _ in first):
        return _ratios(first), math.inf
    counts, threshold = first, None
    for _ in range(MOST_FITS):
        ratios, before = _ratios(counts), threshold
        # Ratios lie within a few dozen, so their histogram is small whatever the number of strings.
        step = F.floor(_ratio(ratios, F.col("value")) * GRAIN).cast("int").alias("step")
        held: dict[int, list[tuple[int, int]]] = {0: [], 1: []}
        for r in runs.select("label", "n", step).groupBy("label", "step").agg(F.sum("n").alias("n")).collect():
            held[r["label"]].append((r["step"], r["n"]))
        threshold, sure = _threshold(held[0], held[1])
        if before is not None and abs(threshold - before) < STABLE:
            break
        more = transitions(runs.where(~short & (_ratio(ratios, F.col("value")) <= sure)))
        counts = {k: first.get(k, 0) + more.get(k, 0) for k in first.keys() | more.keys()}
    return ratios, threshold


def _quantile(histogram: list[tuple[int, int]], share: float) -> float:
    """The ratio that a share of a histogram's strings does not exceed."""
    rest = share * sum(n for _, n in histogram)
    for step, n in sorted(histogram):
        rest -= n
        if rest <= 0:
            break
    return step / GRAIN


@tidy
def with_secrets(docs: DataFrame, samples: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, _base and _all: sorted spans as array<struct<start, rank, end>>; rank indexes KINDS."""
    found = stage(scan(docs, text_col, keep), "secret-matches")
    table, threshold = train(samples)

    def ranked(column: str, rank: int) -> Column:
        return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))

    base = F.array_sort(F.concat(*(ranked(f"_{k}", i) for i, k in enumerate(KINDS[:3]))))
    free = F.filter("_run", lambda x: ~F.exists("_base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    odd = F.filter(free, lambda x: _ratio(table, x["value"]) > F.lit(threshold))
    model = F.transform(odd, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("rank"), x["end"].alias("end")))
    return found.withColumn("_base", base).select(*keep, "_base", F.array_sort(F.concat("_base", model)).alias("_all"))


def joined(spans: str) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: str) -> Column:
    """The text with every span, overlapping ones as one, replaced by REDACTED."""
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(REDACTED))).alias("out"))
        longer = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["start"] >= acc["at"], fresh).otherwise(longer)

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, state, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    )


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = with_secrets(docs, labelled_samples(docs))

    def count(rank: int) -> Column:
        return F.size(F.filter("_base", lambda x: x["rank"] == rank)).cast("long")

    return found.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])), F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_all").alias("spans")
    )
