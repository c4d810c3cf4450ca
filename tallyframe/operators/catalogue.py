"""Document catalogues: indexes of mirrors and full texts, coverage, exploration tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import composite_key, date_of_fulltext, date_of_mirror
from .joins import cross_catalogues, first_wins


def index_fulltext(items: DataFrame) -> DataFrame:
    """items (seqDocumento, numeroRegistro, dataPublicacao, tipoDocumento, processo, ministro, file) -> index rows; incomplete ones are skipped."""
    date = date_of_fulltext("dataPublicacao")
    own = items.select(
        F.trim(F.col("numeroRegistro").cast("string")).alias("numero_registro"), date.alias("data_publicacao"), F.trim("tipoDocumento").alias("tipo_decisao"),
        F.col("seqDocumento").cast("bigint").cast("string").alias("seq_documento"), "processo", "ministro", "file",
    )
    complete = own.filter((F.coalesce("numero_registro", F.lit("")) != "") & (F.col("data_publicacao") != "") & (F.coalesce("tipo_decisao", F.lit("")) != ""))
    return complete.withColumn("id_mapa", composite_key("numero_registro", "data_publicacao", "tipo_decisao"))


def index_mirror(items: DataFrame) -> DataFrame:
    """items (numeroRegistro, dataPublicacao, tipoDeDecisao, siglaClasse, file) -> index rows; the body is the file's prefix."""
    own = items.select(F.trim("numeroRegistro").alias("numero_registro"), date_of_mirror("dataPublicacao").alias("data_publicacao"), F.trim("tipoDeDecisao").alias("tipo_decisao"), "siglaClasse", F.regexp_extract("file", r"^([^-_.]+)", 1).alias("orgao"), "file")
    return own.filter((F.col("numero_registro") != "") & (F.col("data_publicacao") != "")).withColumn("id_mapa", composite_key("numero_registro", "data_publicacao", "tipo_decisao"))


def incremental(items: DataFrame, index: DataFrame, file: str = "file") -> DataFrame:
    """Items of files that the index has not seen."""
    return items.join(index.select(file).distinct(), file, "left_anti")


def deduplicate(index: DataFrame, order: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key; and all later ones beside the row that was kept."""
    marked = first_wins(index, "id_mapa", order)
    kept = marked.filter("copy = 1").drop("copy")
    later = marked.filter("copy > 1").select("id_mapa", "copy", F.struct(*index.columns).alias("novo"))
    return kept, later.join(kept.select("id_mapa", F.struct(*kept.columns).alias("existente")), "id_mapa")


def build_mirror_dataset(mirror: DataFrame, fulltext: DataFrame, order: list[str | Column]) -> DataFrame:
    kept, _ = deduplicate(mirror, order)
    texts, _ = deduplicate(fulltext.select("id_mapa", "file", "seq_documento", "integra"), ["file", "seq_documento"])
    return cross_catalogues(kept, texts.select("id_mapa", "seq_documento", "integra"))


def years(index: DataFrame, date: str = "data_publicacao") -> list[str]:
    """Distinct years, for partition pruning."""
    return sorted(r[0] for r in index.select(F.substring(date, 1, 4)).distinct().collect())


def zip_texts(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) -> (zip, member, seq, text); each archive is opened once, error bodies are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import re
        import zipfile

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith("/"):
                            continue
                        raw = z.read(name)
                        try:
                            text = raw.decode("utf-8")
                        except UnicodeDecodeError:
                            text = raw.decode("latin-1")
                        if text.lstrip().startswith("#ERRO"):
                            continue
                        stem = re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1])
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, name, stem, text)], ["zip", "member", "seq", "text"])

    return files.select("path", "content").mapInArrow(run, "zip string, member string, seq string, text string")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count and share of every value of categorical columns; null is "(vazio)"."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("(vazio)")).alias("value")) for c in columns))))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("column")), 3))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed, with shares."""
    lo, hi, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint, pct double")
    width = (hi - lo) / bins or 1
    k = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / width)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counts, "bin", "left").na.fill(0, ["n"])
    return out.select("bin", (F.lit(float(lo)) + F.col("bin") * F.lit(float(width))).alias("low"), (F.lit(float(lo)) + (F.col("bin") + 1) * F.lit(float(width))).alias("high"), "n", F.round(100 * F.col("n") / n, 3).alias("pct"))


def coverage(df: DataFrame, text: str, by: list[str] = ()) -> DataFrame:
    """Rows with and without text, and the lengths of the texts."""
    size = F.when(F.coalesce(F.trim(text), F.lit("")) != "", F.length(text))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(size).alias("with_text"), F.count_if(size.isNull()).alias("without_text"), F.avg(size).alias("mean"), F.median(size).alias("median"), F.min(size).alias("min"), F.max(size).alias("max"), F.sum(size).alias("total"))


def top_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def stratified_percent(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of each value within its group."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(group)), 3))


def sample_priority(df: DataFrame, a: str, b: str, key: str, n: int = 2) -> DataFrame:
    """Rows with both texts first, then one, then none."""
    has = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "").cast("int")
    return df.orderBy(F.desc(has(a) + has(b)), key).limit(n)


def preferred_order(df: DataFrame, column: str, preferred: list[str]) -> DataFrame:
    """Preferred values first in their order, the others by name."""
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(preferred) + 1), column)


def fixed_columns(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Literal columns; $hoje and $agora are today's date and the time now."""
    special = {"$hoje": F.current_date().cast("string"), "$agora": F.current_timestamp().cast("string")}
    return df.withColumns({k: special.get(v, F.lit(v)) for k, v in values.items()})


def derived_columns(df: DataFrame) -> DataFrame:
    """Class, year and ISO date from the process and the publication date."""
    d = F.col("data_publicacao")
    return df.withColumns({"sg_classe": F.split("processo", " ")[0], "ano": F.substring(d, 1, 4), "dt_publicacao": F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))})


def standard_types(df: DataFrame, ids: list[str], dates: list[str]) -> DataFrame:
    """Ids as text without a decimal part, dates trimmed."""
    return df.withColumns({c: F.regexp_replace(F.trim(F.col(c).cast("string")), r"\.0$", "") for c in ids} | {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in dates})
