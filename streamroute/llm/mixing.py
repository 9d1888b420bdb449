"""Mixing sources to target weights, measured in tokens, with a cap on repetitions.

Capped water-filling: a source's amount is its share of the total, clamped at max_repeats times its size; what the
clamped ones can't give goes to the others in proportion to their shares, until nothing is left over. A source then
repeats whole times and once more for a seeded part of its documents.

The extra part is exact to about one document: documents are ordered by a seeded hash, hash buckets below the
threshold bucket are taken whole (from one histogram per source), and only the threshold bucket is walked in order.

Defined results: rows without a source take no part; a target whose source has no documents or no tokens gives 0; null
or negative shares count as 0, null max_repeats as 1; several targets for one source of a mix are added up (the
largest cap holds); a mix whose sources can't fill the total is filled as far as the caps go.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamroute.llm.bpe import DEFAULT_TOKENIZER, count_tokens
from streamroute.session import join_small, materialize

#: Hash buckets of a source's histogram.
BUCKETS = 4096


def water_fill(share: np.ndarray, cap: np.ndarray, total: float) -> np.ndarray:
    """Amounts adding up to min(total, what the caps allow), in proportion to the shares except where clamped."""
    amount = np.zeros(len(share))
    open_ = (share > 0) & (cap > 0)
    left = float(total)
    while open_.any() and left > 0:
        want = np.zeros(len(share))
        want[open_] = left * (share[open_] / share[open_].sum())
        full = open_ & (want >= cap)
        if not full.any():
            amount[open_] = want[open_]
            break
        amount[full] = cap[full]
        left -= cap[full].sum()
        open_ &= ~full
    return amount


def token_sizes(docs: DataFrame, text: str = "text", path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """doc_id, source and n_tokens of the documents that have a source, written once to the shared folder."""
    sized = count_tokens(docs.where(F.col("source").isNotNull()), text, ("doc_id", "source"), path)
    return materialize(sized, "token-sizes")


def plan_mixes(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per mix and source: wanted share, size, amount to take, whole repetitions and the part of a further one.

    total_tokens: size of each mix; by default the size of its available sources, once each.
    """
    per_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n_docs"))
    share = F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)
    wanted = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum(share).alias("share"), F.max(F.coalesce(F.greatest("max_repeats", F.lit(0)), F.lit(1))).alias("max_repeats")
    )
    # targets are a small fixed table; the sizes have one row a source
    joined = join_small(per_source, wanted.select("source").distinct(), ["source"], "left_semi")
    joined = wanted.join(joined, "source", "left").fillna(0, ["size", "n_docs"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        share, size, cap = pdf["share"].to_numpy(float), pdf["size"].to_numpy(float), pdf["max_repeats"].to_numpy(float)
        total = float(total_tokens) if total_tokens is not None else size[share > 0].sum()
        amount = water_fill(share, size * cap, total)
        epochs = np.divide(amount, size, out=np.zeros(len(size)), where=size > 0)
        whole = np.floor(epochs + 1e-12)
        s, a = share.sum(), amount.sum()
        return pd.DataFrame(
            {
                "mix_id": pdf["mix_id"], "source": pdf["source"], "target_share": share / s if s else share, "max_repeats": pdf["max_repeats"],
                "size": pdf["size"], "n_docs": pdf["n_docs"], "amount": amount, "planned_share": amount / a if a else amount,
                "whole": whole.astype("int32"), "extra_tokens": np.maximum(0, amount - whole * size),
            }
        )

    schema = "mix_id string, source string, target_share double, max_repeats int, size bigint, n_docs bigint, amount double, planned_share double, whole int, extra_tokens double"
    return joined.groupBy("mix_id").applyInPandas(fill, schema)


def sample_mixes(sizes: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """mix_id, source, doc_id, n_tokens and repeats (at least 1) of every document of every mix."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    hashed = sizes.withColumns({"h": h, "bucket": F.shiftrightunsigned(h, 64 - BUCKETS.bit_length() + 1).cast("int")})
    hist = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    # one row per mix, source and bucket: at most BUCKETS for each target row
    small = plan.select("mix_id", "source", "whole", "extra_tokens")
    run = F.sum("n").over(Window.partitionBy("mix_id", "source").orderBy("bucket"))
    cut = join_small(hist, small, ["source"]).withColumn("upto", run)
    cut = cut.where(F.col("upto") - F.col("n") < F.col("extra_tokens")).groupBy("mix_id", "source").agg(F.max_by(F.struct("bucket", F.expr("upto - n").alias("below")), "bucket").alias("c"))
    cuts = small.join(cut, ["mix_id", "source"], "left").select("mix_id", "source", "whole", "extra_tokens", F.coalesce("c.bucket", F.lit(-1)).alias("cut"), F.coalesce("c.below", F.lit(0)).alias("below"))
    rows = join_small(hashed, cuts, ["source"])
    # buckets below the threshold are taken, those above it aren't; only the threshold bucket is walked in hash order
    sure = rows.where(F.col("bucket") != F.col("cut")).withColumn("extra", (F.col("bucket") < F.col("cut")).cast("int"))
    before = F.sum("n_tokens").over(Window.partitionBy("mix_id", "source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    at_cut = rows.where(F.col("bucket") == F.col("cut")).withColumn("before", F.coalesce(before, F.lit(0)))
    fits = F.col("below") + F.col("before") + F.col("n_tokens") / 2 <= F.col("extra_tokens")
    at_cut = at_cut.withColumn("extra", fits.cast("int")).drop("before")
    taken = sure.unionByName(at_cut).withColumn("repeats", (F.col("whole") + F.col("extra")).cast("int"))
    return taken.where("repeats > 0").select("mix_id", "source", "doc_id", "n_tokens", "repeats")


def reached_shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target: the shares asked for, planned and reached, tokens taken and repetitions."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    both = plan.join(got, ["mix_id", "source"], "left").fillna(0, ["tokens", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return both.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), whole.cast("double")), F.lit(0.0))).select(
        "mix_id", "source", "target_share", "max_repeats", "size", "planned_share", "tokens", "most_repeats", "reached_share"
    )
