"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: A cell of which more than this share is wanted is kept whole.
WHOLE = 1 - 1e-9
#: Rounds that one plan holds.
PLANNED = 4
#: Cells up to this many are broadcast to the documents; more are joined by a shuffle.
BROADCAST_CELLS = 20_000


def topic_of(text: str = "text") -> Column:
    """A coarse topic read from the text's form: table, noise, numeric, note or prose."""
    c = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(c.contains(" | "), "table")
        .when(c.rlike("[#$%&*]{3}"), "noise")
        .when(c.rlike("[0-9]{6}"), "numeric")
        .when(F.octet_length(c) < 600, "note")
        .otherwise("prose")
    )


def token_weight(text: str = "text") -> Column:
    """About four bytes a token, one token at least."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 3) / 4)).cast("long")


def uniform(seed: str, name: str) -> Column:
    """A number in [0, 1) that the seed and the row's id fix."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: DataFrame, dims: list[str], targets: Mapping[str, Mapping[str, float]], *, budget: float, temper: float, rounds: int, fillings: int) -> DataFrame:
    """cells with weight (share of the kept tokens), probability (share of the cell's tokens that is kept) and residual.

    A target given as {category: share} is used over the categories there are, scaled to one; categories it leaves out
    keep nothing.  A dimension without one aims at its token shares to the power temper, scaled to one.  A category
    cannot keep more tokens than it has: what its share of the budget exceeds them goes to the others in proportion
    (`fillings` rounds).  Then the kept tokens are raked to these aims: each round and dimension scales a category's
    cells so that they keep its aim, where cells that are kept whole count as such and only the others make up the
    rest.  residual is the largest difference of a category's kept tokens from its aim, as a share of all kept.
    """
    total = Window.partitionBy()
    out = cells.coalesce(1).withColumn("_budget", F.lit(float(budget)) * F.sum("tokens").over(total))
    for dim in dims:
        own = Window.partitionBy(dim)
        out = out.withColumn(f"_n{dim}", F.count("*").over(own)).withColumn(f"_has{dim}", F.sum("tokens").over(own).cast("double"))
        given = targets.get(dim)
        share = F.pow(F.col(f"_has{dim}"), F.lit(temper))
        if given:
            share = F.lit(0.0)
            for category, x in given.items():
                share = F.when(F.col(dim) == category, F.lit(float(x))).otherwise(share)
        out = out.withColumn(f"_share{dim}", share)
    # Each category counts once in a sum over cells: what it has is spread over its cells.
    level = [F.try_divide("_budget", F.sum(F.col(f"_share{d}") / F.col(f"_n{d}")).over(total)).alias(f"_level{d}") for d in dims]
    out = out.select("*", *level)
    for _ in range(fillings):
        raised = []
        for d in dims:
            full = F.col(f"_has{d}") <= F.col(f"_level{d}") * F.col(f"_share{d}")
            filled = F.sum(F.when(full, F.col(f"_has{d}") / F.col(f"_n{d}")).otherwise(0.0)).over(total)
            open_ = F.sum(F.when(full, 0.0).otherwise(F.col(f"_share{d}") / F.col(f"_n{d}"))).over(total)
            raised.append(F.coalesce(F.when(open_ > 0, (F.col("_budget") - filled) / open_), F.col(f"_level{d}")).alias(f"_level{d}"))
        out = out.select(*(c for c in out.columns if not c.startswith("_level")), *raised)
    aims = [F.coalesce(F.least(f"_has{d}", F.col(f"_level{d}") * F.col(f"_share{d}")), F.lit(0.0)).alias(f"_aim{d}") for d in dims]
    out = checkpoint(out.select(*cells.columns, *aims, (F.lit(float(budget)) * F.col("tokens")).alias("_want")))
    for i in range(rounds):
        if i and i % PLANNED == 0:
            out = checkpoint(out)
        for dim in dims:
            own = Window.partitionBy(dim)
            whole = F.col("_want") > F.col("tokens") * WHOLE
            out = out.withColumn("_fixed", F.sum(F.when(whole, F.col("tokens")).otherwise(0)).over(own).cast("double")).withColumn("_free", F.sum(F.when(whole, 0.0).otherwise(F.col("_want"))).over(own))
            aim = F.col(f"_aim{dim}")
            factor = F.when(aim <= F.col("_fixed"), F.try_divide(aim, F.col("_fixed") + F.col("_free"))).otherwise(F.when(F.col("_free") > 0, (aim - F.col("_fixed")) / F.col("_free")).otherwise(1.0))
            out = out.withColumn("_want", F.col("_want") * F.coalesce(factor, F.lit(0.0)))
    kept = F.least(F.col("_want"), F.col("tokens"))
    off = [F.abs(F.sum(kept).over(Window.partitionBy(d)) - F.col(f"_aim{d}")) for d in dims]
    out = out.withColumn("weight", F.coalesce(F.try_divide(kept, F.sum(kept).over(total)), F.lit(0.0))).withColumn("_off", F.greatest(*off) if len(off) > 1 else off[0])
    out = out.withColumn("residual", F.coalesce(F.try_divide(F.max("_off").over(total), F.sum(kept).over(total)), F.lit(0.0)))
    return checkpoint(out.select(*cells.columns, "weight", F.least(F.lit(1.0), F.col("_want") / F.col("tokens")).alias("probability"), "residual").coalesce(1))


def mix(
    docs: DataFrame,
    *,
    dims: Mapping[str, Column] | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    id_col: str = "doc_id",
    tokens: Column | None = None,
    budget: float = 0.5,
    temper: float = 0.5,
    rounds: int = 12,
    fillings: int = 8,
    seed: str = "mix",
    prefix: str = "mix_",
) -> DataFrame:
    """docs' rows with mix_tokens, mix_weight, mix_probability, mix_residual and mix_kept, and mix_<dimension> for each
    dimension (prefix names them otherwise).

    Tokens are summed by cell (source x language x topic by default; null is a category of its own, apart from every
    text) and the kept tokens raked to the targets of each marginal (see rake).  A document is kept with its cell's
    probability, so that the marginals of the kept tokens meet the targets in expectation as far as there are tokens,
    and `budget` of all tokens is kept unless targets leave out too much.  mix_weight is the cell's share of the kept
    tokens, mix_residual how far the marginals are from the aims after all rounds.  The draw is fixed by the seed and
    the id, so repeated rows with one id fall alike, and a lost task draws the same again.  No rows give no rows;
    columns of docs of the added names are replaced.

    The scan is aggregated to cells before anything is shuffled: only sums of cells, bounded by the product of the
    dimensions' categories, meet in one task.  Documents are never shuffled: the cells are broadcast after a check of
    their number (with more than BROADCAST_CELLS they are joined by a shuffle).
    """
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of()}
    names = list(dims)
    keys = [f"{prefix}{d}" for d in names]
    added = [*keys, *(f"{prefix}{c}" for c in ("tokens", "weight", "probability", "residual", "kept"))]
    rows = docs.drop(*added)
    own = rows.columns
    rows = rows.select(*(F.col(f"`{c}`") for c in own), *(c.cast("string").alias(k) for k, c in zip(keys, dims.values(), strict=True)), (tokens if tokens is not None else token_weight()).alias(f"{prefix}tokens"))
    cells = rows.groupBy(*keys).agg(F.sum(f"{prefix}tokens").alias("tokens"))
    raked = rake(cells, keys, {f"{prefix}{d}": t for d, t in (targets or {}).items()}, budget=budget, temper=temper, rounds=rounds, fillings=fillings)
    out = raked.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"{prefix}{c}") for c in ("weight", "probability", "residual")))
    out = F.broadcast(out) if out.count() <= BROADCAST_CELLS else out
    match = F.lit(True)
    for k in keys:
        match = match & rows[k].eqNullSafe(out[f"_{k}"])
    kept = (uniform(seed, id_col) < F.col(f"{prefix}probability")).alias(f"{prefix}kept")
    return rows.join(out, match).select(*(rows[c] for c in own), *(rows[k] for k in keys), *(f"{prefix}{c}" for c in ("tokens", "weight", "probability", "residual")), kept)


def marginals(mixed: DataFrame, dims: Sequence[str] = ("source", "lang", "topic"), *, prefix: str = "mix_") -> DataFrame:
    """A row a dimension and category of mix's result: tokens, expected (kept in expectation) and kept (as drawn)."""
    weighed = mixed.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"{prefix}{d}").alias("category")) for d in dims))).alias("of"), *(F.col(f"{prefix}{c}").alias(c) for c in ("tokens", "probability", "kept")))
    sums = weighed.groupBy("of.dimension", "of.category")
    return sums.agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("expected"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("kept"))


def mix_sql(*, budget: float = 0.5, temper: float = 0.5, rounds: int = 12, fillings: int = 8, seed: str = "mix") -> str:
    """The same for the default dimensions in SQL, rounds written out."""
    dims = ("source", "lang", "topic")
    steps = [
        r"""rows AS (
  SELECT doc_id, source, lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[#$%&*]{3}') THEN 'noise'
      WHEN regexp_matches(coalesce(text, ''), '[0-9]{6}') THEN 'numeric' WHEN strlen(coalesce(text, '')) < 600 THEN 'note' ELSE 'prose' END AS topic,
    greatest(1, (strlen(coalesce(text, '')) + 3) // 4) AS tokens FROM documents
)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM rows GROUP BY ALL)",
        f"wanted AS (SELECT {budget} * sum(tokens) AS budget FROM cells)",
    ]
    for d in dims:
        steps.append(f"has_{d} AS (SELECT {d}, sum(tokens) AS has, pow(sum(tokens), {temper}) AS share FROM cells GROUP BY {d})")
        steps.append(f"{d}_0 AS (SELECT budget / (SELECT sum(share) FROM has_{d}) AS level FROM wanted)")
        for i in range(fillings):
            steps.append(f"{d}_{i + 1} AS MATERIALIZED (SELECT coalesce((any_value(budget) - coalesce(sum(has) FILTER (has <= level * share), 0)) / nullif(sum(share) FILTER (has > level * share), 0), any_value(level)) AS level FROM has_{d}, {d}_{i}, wanted)")
        steps.append(f"aim_{d} AS (SELECT {d}, least(has, level * share) AS aim FROM has_{d}, {d}_{fillings})")
    steps.append(f"w0 AS (SELECT *, {budget} * tokens AS want FROM cells)")
    k = 0
    for _ in range(rounds):
        for d in dims:
            sums = f"SELECT w{k}.*, aim, sum(CASE WHEN want > tokens * {WHOLE!r} THEN tokens ELSE 0 END) OVER (PARTITION BY w{k}.{d}) AS fixed, sum(CASE WHEN want > tokens * {WHOLE!r} THEN 0 ELSE want END) OVER (PARTITION BY w{k}.{d}) AS free FROM w{k} JOIN aim_{d} ON w{k}.{d} IS NOT DISTINCT FROM aim_{d}.{d}"
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (want, aim, fixed, free), want * CASE WHEN aim <= fixed THEN aim / (fixed + free) WHEN free > 0 THEN (aim - fixed) / free ELSE 1 END AS want FROM ({sums}))")
            k += 1
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT r.doc_id, r.source, r.lang, r.topic, CAST(r.tokens AS BIGINT) AS tokens, round(weight, 9) AS weight, round(probability, 9) AS probability,
  CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) / 4294967296.0 < probability AS kept
FROM rows r JOIN (SELECT *, least(want, tokens) / sum(least(want, tokens)) OVER () AS weight, least(1.0, want / tokens) AS probability FROM w{k}) s
  ON r.source IS NOT DISTINCT FROM s.source AND r.lang IS NOT DISTINCT FROM s.lang AND r.topic = s.topic"""
    )
