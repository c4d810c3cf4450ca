"""Bayesian comparison of pairs: left, practically equal (within a rope), right."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import student_cdf
from .frequentist import MAX_PROTOCOLS, bounded, pair_deltas

DECIDED = 0.80

#: Differences of a pair that the rank method holds as a square table.
MAX_DIFFERENCES = 4000


@dataclass
class PairResult:
    left: float
    rope: float
    right: float

    def relation(self) -> str:
        """The likeliest of the three, decided or not."""
        return max((("x_melhor", self.left), ("empate", self.rope), ("y_melhor", self.right)), key=lambda t: t[1])[0]

    def decided(self, limit: float = DECIDED) -> str:
        return self.relation() if max(self.left, self.rope, self.right) >= limit else "indefinido"

    def mirror(self) -> "PairResult":
        return PairResult(self.right, self.rope, self.left)


def counts(deltas: DataFrame, rope: float) -> DataFrame:
    """Wins, ties within the rope, and losses per pair, with moments of the difference."""
    d = F.col("d")
    return deltas.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(d > rope).alias("wins"), F.count_if(F.abs(d) <= rope).alias("ties"), F.count_if(d < -rope).alias("losses"),
        F.avg(d).alias("mean"), F.coalesce(F.var_samp(d), F.lit(0.0)).alias("var"),
    )


def sign_test(wins: int, ties: int, losses: int, samples: int = 50_000, seed: int = 42, prior: float = 1.0) -> PairResult:
    """Dirichlet posterior of the three shares, one prior observation in the rope; shares of samples each is largest in."""
    draws = np.random.default_rng(seed).dirichlet([wins + 1e-6, ties + prior, losses + 1e-6], samples)
    share = np.bincount(draws.argmax(1), minlength=3) / samples
    return PairResult(*share.tolist())


def correlated_t(n: int, mean: float, var: float, rope: float, rho: float = 0.0) -> PairResult:
    """Posterior of the mean difference as a Student distribution with a correlation correction."""
    scale = math.sqrt(var * (1 / n + rho / (1 - rho)))
    if n < 2 or scale == 0:
        return PairResult(float(mean > rope), float(abs(mean) <= rope), float(mean < -rope))
    low, high = student_cdf((-rope - mean) / scale, n - 1), student_cdf((rope - mean) / scale, n - 1)
    return PairResult(1 - high, high - low, low)


def signed_rank(differences: np.ndarray, rope: float, samples: int = 2000, seed: int = 42) -> PairResult:
    """Dirichlet weights over the differences (and a prior one at 0); pairs of sums left of, in and right of the rope."""
    d = np.append(0.0, np.asarray(differences, float))
    sums = d[:, None] + d[None, :]
    kinds = np.stack([sums > 2 * rope, np.abs(sums) <= 2 * rope, sums < -2 * rope]).astype(float)
    w = np.random.default_rng(seed).dirichlet(np.ones(len(d)), samples)
    share = np.stack([np.einsum("si,ij,sj->s", w, k, w, optimize=True) for k in kinds], 1)
    return PairResult(*(np.bincount(share.argmax(1), minlength=3) / samples).tolist())


def matrix(scores: DataFrame, rope: float, method: str = "sinais", limit: float = DECIDED) -> list[dict]:
    """Every ordered pair; the mirror is derived from the other direction.

    Methods: "sinais" (signs), "postos" (signed ranks over a pair's differences, MAX_DIFFERENCES at most), "t" (correlated t).
    """
    if method not in ("sinais", "postos", "t"):
        raise ValueError(f"unknown method {method!r}")
    if rope <= 0:
        raise ValueError("the rope must be positive")
    deltas = pair_deltas(scores)
    rows = bounded(counts(deltas, rope).orderBy("a", "b"), MAX_PROTOCOLS**2)
    out = []
    for r in rows:
        if method == "sinais":
            got = sign_test(r["wins"], r["ties"], r["losses"])
        elif method == "postos":
            own = bounded(deltas.filter((F.col("a") == r["a"]) & (F.col("b") == r["b"])).select("d"), MAX_DIFFERENCES)
            got = signed_rank(np.sort([x[0] for x in own]), rope)
        else:
            got = correlated_t(r["n"], r["mean"], r["var"], rope)
        for x, y, result, mean in ((r["a"], r["b"], got, r["mean"]), (r["b"], r["a"], got.mirror(), -r["mean"])):
            out.append({"linha": x, "coluna": y, "n": r["n"], "metodo": method, "rope": rope, "p_esquerda": result.left, "p_rope": result.rope, "p_direita": result.right, "diferenca_media": mean, "classificacao": result.decided(limit), "probabilidade": max(result.left, result.rope, result.right)})
    return out


def relation_summary(rows: list[dict]) -> dict[str, dict[str, int]]:
    """Superior, equivalent, inferior and uncertain relations per protocol."""
    names = {"x_melhor": "superior", "empate": "equivalente", "y_melhor": "inferior", "indefinido": "incerto"}
    out: dict[str, dict[str, int]] = {}
    for r in rows:
        own = out.setdefault(r["linha"], dict.fromkeys(names.values(), 0))
        own[names[r["classificacao"]]] += 1
    return out


def rope_sensitivity(scores: DataFrame, rope: float) -> dict[str, int]:
    """Classes per rope (half, whole, double) that differ from those of the whole rope."""
    base = {(r["linha"], r["coluna"]): r["classificacao"] for r in matrix(scores, rope)}
    return {f"{f:g}": sum(base[r["linha"], r["coluna"]] != r["classificacao"] for r in matrix(scores, rope * f)) for f in (0.5, 1.0, 2.0)}


def findings(rows: list[dict]) -> dict:
    """Decided and undecided unordered pairs, and leaders (nobody beats them)."""
    beaten = {r["linha"] for r in rows if r["classificacao"] == "y_melhor"}
    decided = sum(r["classificacao"] != "indefinido" for r in rows) // 2
    return {"decided": decided, "undecided": len(rows) // 2 - decided, "leaders": sorted({r["linha"] for r in rows} - beaten)}
