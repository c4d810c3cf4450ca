"""Writers: tables by extension, CSV exports, per-key files, markdown."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, or CSV with ";" by the extension; anything else is parquet."""
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).option("sep", ";").csv(path)
    else:
        df.write.mode(mode).parquet(path)


def export_csv(results: DataFrame, stats: DataFrame | None, path: str, sep: str = ",") -> None:
    results.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
    if stats is not None:
        stats.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(f"{path}.estatisticas")


def export_judge(judge: DataFrame, path: str, decimal_comma: bool = True) -> DataFrame:
    """Mean P, R and F1 per model and field to 4 decimals; with a decimal comma for ";" files."""
    own = judge.groupBy("model", "field").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("p", "r", "f1")))
    if decimal_comma:
        own = own.select("model", "field", *(F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) for c in ("p", "r", "f1")))
    own.coalesce(1).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    return own


def write_json_per_model(df: DataFrame, path: str) -> None:
    """One folder per model of JSON lines, instead of one file per document."""
    df.write.mode("overwrite").partitionBy("model").json(path)


def markdown_table(rows: Iterable[dict], decimals: int = 4) -> str:
    """Rows as a markdown table; numbers with a decimal comma and no more decimals than a column needs."""
    rows = list(rows)
    if not rows:
        return ""
    names = list(rows[0])

    def digits(name: str) -> int:
        values = [r[name] for r in rows if isinstance(r[name], float) and r[name] == r[name]]
        return next((d for d in range(decimals + 1) if all(round(v, d) == round(v, decimals) for v in values)), decimals)

    shown = {n: digits(n) for n in names}
    cell = lambda n, v: f"{v:.{shown[n]}f}".replace(".", ",") if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(cell(n, r[n]) for n in names) + " |" for r in rows])


class SectionedReport:
    """A markdown text with named sections that can be replaced."""

    def __init__(self, title: str):
        self.title, self.sections = title, {}

    def put(self, name: str, body: str) -> None:
        self.sections[name] = body.strip()

    def text(self) -> str:
        return "\n\n".join([f"# {self.title}", *(f"## {n}\n\n{b}" for n, b in self.sections.items())]) + "\n"


def validate_columns(df: DataFrame, required: list[str], optional: list[str] = ()) -> list[str]:
    """Messages about required columns that are missing and optional ones that are absent."""
    have = set(df.columns)
    return [f"missing: {c}" for c in required if c not in have] + [f"absent: {c}" for c in optional if c not in have]


def write_files(df: DataFrame, folder: str) -> None:
    """A .txt and a .json file per key (chave, resposta, resumo, erro) through Hadoop's text writer: one folder per key."""
    own = df.select("chave", F.coalesce("resposta", F.lit("")).alias("value"))
    own.write.mode("overwrite").partitionBy("chave").text(f"{folder}/txt")
    df.select("chave", F.to_json(F.struct("chave", "resumo", "erro")).alias("value")).write.mode("overwrite").partitionBy("chave").text(f"{folder}/json")


def batched(rows: Iterator, n: int) -> Iterator[list]:
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held
