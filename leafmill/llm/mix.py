"""A collection in which each source has its target share of the tokens.

Entropy balancing: of all document rates r with 0 <= r <= max_repeats and sum(r * tokens) = share * total for
every source, take those nearest in relative entropy to sampling all documents at one rate. They are
r = min(max_repeats, rate * exp(lambda_s * tokens / mean_s)); lambda solves the convex dual by Newton's method,
kept in a bracket, with one distributed aggregation per step over all sources together.

Rates become whole copies by systematic rounding in order of size: running sums of the rates (in integers,
over blocks first, so a source with a third of all rows is spread) step over whole numbers. What is then
missing in a source is set right by single copies of the documents whose size fits best.

The total is the largest for which every source that has documents can reach its share, or the one asked
for, in tokens or AVAILABLE; in the latter cases sources that would need more than max_repeats give all they have and are reported
as short. Sources without documents get nothing, and their share falls to the others in proportion.

Tokens are those of the byte-level BPE vocabulary at `vocabulary`.

Cases: source names are compared without case, surrounding space and with "-" as "_"; documents without text, tokens or a
wanted source are not used; repeated documents are documents of their own; a share of null or 0 or max_repeats below 1
makes a source unwanted; several rows for one source add their shares and take the larger max_repeats; no usable
source gives an empty collection; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.session import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's makers split text before merging.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rates are rounded in units of 2**-20.
UNIT = 1 << 20
#: Sources in the table of targets; it is sent to every task.
MAX_SOURCES = 10_000
#: Newton steps at most, and how far from its goal a source may be after them, as a share of the goal.
STEPS, FAR_OFF = 60, 1e-3
#: As a total: as many tokens as the wanted sources have.
AVAILABLE = "available"


def token_counter(vocabulary: str = VOCABULARY) -> Callable[[Column], Column]:
    """A column function that counts the tokens of a text; null counts 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        coder = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def source_key(source: Column) -> Column:
    """The one spelling of a source's name."""
    return F.replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), F.lit("-"), F.lit("_"))


@dataclass
class Source:
    """What is wanted from, known of and reached in one source."""

    share: float
    cap: int
    docs: int = 0
    tokens: int = 0
    goal: float = 0.0
    lam: float = 0.0
    full: bool = False  # every document at max_repeats


def read_targets(mix_targets: DataFrame) -> dict[str, Source]:
    rows = (
        mix_targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1")
        .groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r.source: Source(r.share, r.cap) for r in rows}


def sized_documents(documents: DataFrame, wanted: dict[str, Source], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(row_no, doc_id, source, tokens) of the usable documents, written once; row_no tells repeated documents apart."""
    rows = documents.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("source").isin(list(wanted)) & (F.octet_length("text") > 0))
    sized = rows.select("doc_id", "source", token_counter(vocabulary)("text").alias("tokens"))
    return materialise(sized.where("tokens > 0").select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "source", "tokens"))


def solve(sized: DataFrame, sources: dict[str, Source], total: int | str | None = None, tolerance: float = 1e-7, steps: int = STEPS) -> float:
    """Sets goal, lam and full of each source by Newton steps on the dual; returns the rate all documents start from. If a source is still FAR_OFF its goal
    after the last step, that is an error."""
    for r in sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).collect():
        sources[r.source].docs, sources[r.source].tokens = r.docs, r.tokens
    live = {k: s for k, s in sources.items() if s.docs}
    if not live:
        return 0.0
    held = sum(s.share for s in live.values())
    largest = min(s.cap * s.tokens / (s.share / held) for s in live.values())
    size = largest if total is None else float(sum(s.tokens for s in live.values()) if total == AVAILABLE else total)
    rate = size / sum(s.tokens for s in live.values())
    for s in live.values():
        s.goal = float(min(s.share / held * size, s.cap * s.tokens))
        s.full = s.goal >= s.cap * s.tokens * (1 - 1e-12)
    low, high = dict.fromkeys(live, -float("inf")), dict.fromkeys(live, float("inf"))
    open_, off = {k for k, s in live.items() if not s.full}, {}
    for _ in range(steps):
        if not open_:
            break
        for r in (
            with_rates(sized.where(F.col("source").isin(list(open_))), live, rate)
            .groupBy("source").agg(F.sum(F.col("rate") * F.col("tokens")).alias("got"), F.sum(F.when(F.col("rate") < F.col("cap"), F.col("rate") * F.col("tokens") * F.col("x")).otherwise(0.0)).alias("slope")).collect()
        ):
            s, gap = live[r.source], r.got - live[r.source].goal
            off[r.source] = abs(gap) / s.goal
            if abs(gap) <= tolerance * s.goal:
                open_.discard(r.source)
                continue
            if gap > 0:
                high[r.source] = s.lam
            else:
                low[r.source] = s.lam
            new = s.lam - gap / r.slope if r.slope > 0 else float("nan")
            new = min(max(new, s.lam - 4), s.lam + 4)  # far steps of Newton's method overshoot
            if not low[r.source] < new < high[r.source]:
                new = (low[r.source] + high[r.source]) / 2 if low[r.source] > -float("inf") and high[r.source] < float("inf") else s.lam + (4 if gap < 0 else -4)
            s.lam = new
    far = {k: x for k, x in off.items() if k in open_ and x > FAR_OFF}
    if far:
        raise RuntimeError(f"rates did not converge in {steps} steps: {far}")
    return rate


def with_rates(sized: DataFrame, sources: dict[str, Source], rate: float) -> DataFrame:
    """Adds cap, x = tokens / mean of the source, and rate."""
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("cap", T.IntegerType()), T.StructField("mean", T.DoubleType()), T.StructField("lam", T.DoubleType()), T.StructField("full", T.BooleanType())])
    rows = [(k, s.cap, s.tokens / s.docs, s.lam, s.full) for k, s in sources.items() if s.docs]
    side = sized.sparkSession.createDataFrame(rows, schema)
    x = F.col("tokens") / F.col("mean")
    tilted = F.least(F.col("cap").cast("double"), F.lit(rate) * F.exp(F.least(F.col("lam") * x, F.lit(600.0))))
    return sized.join(F.broadcast(side), "source").select(*sized.columns, "cap", x.alias("x"), F.when(F.col("full"), F.col("cap").cast("double")).otherwise(tilted).alias("rate"))


def rounded(rated: DataFrame) -> DataFrame:
    """`rated` with `copies`: the whole numbers that the running sum of the rates steps over, in order of size."""
    units = rated.withColumn("units", F.round(F.col("rate") * UNIT).cast("long")).withColumn("spread", F.xxhash64("row_no"))
    units = units.withColumn("block", F.col("tokens") * 64 + F.pmod(F.col("spread"), F.lit(64)))
    held = units.groupBy("source", "block").agg(F.sum("units").alias("held"))
    base = held.select("source", "block", F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = F.sum("units").over(W.partitionBy("source", "block").orderBy("spread", "row_no").rowsBetween(W.unboundedPreceding, 0))
    summed = units.withColumn("upto", upto).join(base, ["source", "block"])
    end = F.col("base") + F.col("upto") + UNIT // 2
    copies = F.floor(end / UNIT) - F.floor((end - F.col("units")) / UNIT)
    return summed.select(*rated.columns, copies.cast("int").alias("copies"))


def corrected(chosen: DataFrame, sources: dict[str, Source], rounds: int = 8) -> DataFrame:
    """`chosen` with single copies taken and added so that each source comes near its goal: where it is over, the smallest
    document that brings it under goes; then the one that best fills the gap is added. The nearest state seen stands."""
    spark = chosen.sparkSession
    reached = {r.source: r.got for r in chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("got")).collect()}
    gap = {k: s.goal - reached.get(k, 0) for k, s in sources.items() if s.docs}
    change: dict[str, dict[int, int]] = {k: {} for k in gap}
    best = {k: (abs(g), {}) for k, g in gap.items()}
    settled: set[str] = set()
    schema = "source string, row_no long, extra int"
    for _ in range(rounds):
        open_ = [(k, float(g)) for k, g in gap.items() if k not in settled and abs(g) >= 1]
        if not open_:
            break
        side = F.broadcast(spark.createDataFrame(open_, "source string, gap double"))
        done = F.broadcast(spark.createDataFrame([(k, r, c) for k, rows in change.items() for r, c in rows.items()], schema))
        now = chosen.join(side, "source").join(done, ["source", "row_no"], "left").withColumn("have", F.col("copies") + F.coalesce("extra", F.lit(0)))
        over = F.col("gap") < 0
        now = now.where((over & (F.col("have") > 0)) | (~over & (F.col("have") < F.col("cap"))))
        short = over & (F.col("tokens") < -F.col("gap"))  # taking it is not enough
        off = F.when(short, -F.col("tokens")).otherwise(F.abs(F.abs("gap") - F.col("tokens")))
        moves = now.groupBy("source").agg(F.min(F.struct(short.alias("short"), off.alias("off"), "row_no", "tokens")).alias("b")).collect()
        for r in moves:
            k, sign = r.source, 1 if gap[r.source] > 0 else -1
            if sign > 0 and r.b.off >= gap[k]:
                settled.add(k)
                continue
            change[k][r.b.row_no] = change[k].get(r.b.row_no, 0) + sign
            gap[k] -= sign * r.b.tokens
            if abs(gap[k]) < best[k][0]:
                best[k] = (abs(gap[k]), dict(change[k]))
        settled |= {k for k, _ in open_} - {r.source for r in moves}
    rows = [(k, r, c) for k, (_, made) in best.items() for r, c in made.items()]
    done = F.broadcast(spark.createDataFrame(rows, schema))
    return chosen.join(done, ["source", "row_no"], "left").withColumn("copies", F.col("copies") + F.coalesce("extra", F.lit(0))).drop("extra")


def mixed(documents: DataFrame, mix_targets: DataFrame, total: int | str | None = None, vocabulary: str = VOCABULARY, **columns: str) -> tuple[DataFrame, dict[str, Source]]:
    """(row_no, doc_id, source, tokens, cap, x, rate, copies) of all usable documents, and the sources."""
    sources = read_targets(mix_targets)
    sized = sized_documents(documents, sources, vocabulary=vocabulary, **columns)
    rate = solve(sized, sources, total)
    chosen = materialise(rounded(with_rates(sized, sources, rate)))
    return corrected(chosen, sources), sources


def collection(documents: DataFrame, mix_targets: DataFrame, total: int | str | None = None, **named: str) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents used and how often."""
    return mixed(documents, mix_targets, total, **named)[0].where("copies > 0").select("doc_id", "source", "tokens", "copies")


def shares(documents: DataFrame, mix_targets: DataFrame, total: int | str | None = None, **named: str) -> DataFrame:
    """One row per wanted source: target, what it has, what was taken, the share reached, and whether it is met, short or has no documents."""
    chosen, sources = mixed(documents, mix_targets, total, **named)
    schema = "source string, target_share double, max_repeats int, available_docs long, available_tokens long, goal double"
    wanted = chosen.sparkSession.createDataFrame([(k, s.share, s.cap, s.docs, s.tokens, s.goal) for k, s in sources.items()], schema)
    took = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.sum("copies").cast("long").alias("copies"), F.count_if(F.col("copies") > 0).alias("used_docs"), F.max("copies").alias("most_copies"))
    rows = wanted.join(took, "source", "left").fillna(0, ["mixed_tokens", "copies", "used_docs", "most_copies"])
    everything = F.sum("mixed_tokens").over(W.partitionBy())
    held = F.sum(F.when(F.col("available_docs") > 0, F.col("target_share"))).over(W.partitionBy())
    state = F.when(F.col("available_docs") == 0, "no documents").when(F.col("goal") < F.col("target_share") / held * F.sum("goal").over(W.partitionBy()) * 0.999, "short").otherwise("met")
    return rows.select(
        "source", "target_share", "max_repeats", "available_docs", "available_tokens", "used_docs", "copies", "most_copies", "mixed_tokens",
        F.when(everything > 0, F.col("mixed_tokens") / everything).alias("actual_share"), state.alias("state"),
    )
