"""Difficulty labels, targets, blocks and samples; random order is a hash of the id and a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(id_col: str, seed: int = 42) -> list[Column]:
    """An order that any engine can repeat: md5 of id and seed, then the id."""
    return [F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))), F.col(id_col)]


def difficulty_split(df: DataFrame, by: list[str], id_col: str, f1: Sequence[str], keys: str, cuts: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """Labels by position of the score (sum of F1 columns, null as the group's mean, less the normalised keys)."""
    w = Window.partitionBy(*by)
    filled = [F.coalesce(F.col(c), F.avg(c).over(w), F.lit(0.0)) for c in f1]
    spread = F.max(keys).over(w) - F.min(keys).over(w)
    weight = F.coalesce(F.try_divide(F.col(keys) - F.min(keys).over(w), spread), F.lit(0.0))
    scored = df.withColumn("score", F.round(sum(filled[1:], filled[0]) - weight, 9))
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("score", id_col))
    label = F.when(i <= F.floor(n * cuts[0]), "dificil").when(i <= F.floor(n * cuts[1]), "medio").otherwise("facil")
    return scored.withColumn("position", i).withColumn("dificuldade", label)


def note_edges(n: int, q: int) -> list[float]:
    """Edges of q quantile buckets of the positions 0 to n - 1, interpolated linearly."""
    out = []
    for k in range(q + 1):
        at = (n - 1) * (k / q)
        low = int(at)
        out.append(low + (min(low + 1, n - 1) - low) * (at - low))
    return out


def quantile_note(position: Column, n: int, notes: list[int]) -> Column:
    """The note of a position (from 0) among n; as few rows as notes get the notes in order."""
    if n <= len(notes):
        return F.element_at(F.array(*map(F.lit, notes)), position.cast("int") + 1)
    edges = note_edges(n, len(notes))
    bucket = sum((F.when(position > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return F.element_at(F.array(*map(F.lit, notes)), bucket + 1)


def ratios(parts: dict[str, float | None], names=("treino", "teste", "validacao")) -> dict[str, float]:
    """Shares from percentages or fractions; missing parts divide what is left; the sum becomes 1."""
    given = {k: v / 100 if v > 1 else float(v) for k, v in parts.items() if v is not None}
    missing = [k for k in names if k not in given]
    rest = max(0.0, 1 - sum(given.values()))
    full = given | {k: rest / len(missing) for k in missing}
    total = sum(full.values()) or 1
    return {k: full[k] / total for k in names}


def target_split(df: DataFrame, by: list[str], id_col: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Targets by whole counts int(n * share) in hash order within each group; the last target gets the rest."""
    w = Window.partitionBy(*by)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*shuffled(id_col, seed)))
    names, done, column = list(shares), F.lit(0), None
    for name in names[:-1]:
        done = done + F.floor(n * F.lit(shares[name]))
        column = F.when(i <= done, name) if column is None else column.when(i <= done, name)
    return df.withColumn("alvo", column.otherwise(names[-1]) if column is not None else F.lit(names[-1]))


def balanced_blocks(df: DataFrame, id_col: str, blocks: int = 3, seed: int = 42) -> DataFrame:
    """Blocks whose sizes differ by one at most: exact positions from per-cell counts, not one global sort.

    The hash order is cut into cells of its first two hex digits; offsets of the cells come from their counts.
    """
    order = shuffled(id_col, seed)
    own = df.withColumn("_cell", F.substring(order[0], 1, 2))
    counts = own.groupBy("_cell").agg(F.count(F.lit(1)).alias("_c"))  # 256 rows at most
    w = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_cell", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1
    joined = own.withColumn("_p", place).join(F.broadcast(offsets), "_cell")
    return joined.withColumn("bloco", F.concat(F.lit("b"), (F.pmod(F.col("_p") + F.col("_o"), F.lit(blocks)) + 1).cast("string"))).drop("_cell", "_p", "_o")


def stratified_sample(df: DataFrame, strata: list[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum in hash order; all where there are fewer."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(*shuffled(id_col, seed)))
    return df.withColumn("_p", place).filter(F.col("_p") <= n).drop("_p")


def unified_split(stages: DataFrame) -> DataFrame:
    """stages (ord, alias, id, alvo) -> id, the first stage's target, all aliases."""
    return stages.groupBy("id").agg(F.min_by("alvo", "ord").alias("alvo"), F.array_sort(F.collect_set("alias")).alias("divisoes"))


def eval_global_needed(stages: DataFrame, target: str = "validacao") -> DataFrame:
    """Whether the validation ids of some stage differ from their union."""
    own = stages.filter(F.col("alvo") == target).select("alias", "id").distinct()
    union = own.select("id").distinct().agg(F.count(F.lit(1)).alias("n_union"))
    return own.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).crossJoin(union).agg(F.bool_or(F.col("n") != F.col("n_union")).alias("needed"), F.max("n_union").alias("n_union"))


def limit_per_group(df: DataFrame, group: str, item: str, order: str, n: int) -> DataFrame:
    """Rows of the first n items of each group, by first appearance."""
    first = df.groupBy(group, item).agg(F.min(order).alias("_f"))
    kept = first.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_f", item))).filter(F.col("_k") <= n)
    return df.join(kept.select(group, item), [group, item], "left_semi")


def normalise_target(df: DataFrame) -> DataFrame:
    """id -> id_arquivo, divisao or grupo -> alvo, evaluation names -> validacao."""
    names = {"id": "id_arquivo", "divisao": "alvo", "grupo": "alvo"}
    out = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and v not in df.columns})
    target = F.lower(F.trim("alvo"))
    return out.withColumn("alvo", F.when(target.isin("avaliacao", "avaliação", "eval", "validação"), "validacao").otherwise(target))
