"""Readers: tables with sniffed separators, folders of JSON and text, logs, archives."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import json_of_message
from ..functions.text import is_blank

ENCODINGS = ("utf-8", "latin-1", "cp1252", "iso-8859-1")


def sniff_separator(header: str) -> str:
    """The separator that splits a header line into most parts."""
    try:
        return csv.Sniffer().sniff(header, delimiters=",;\t|").delimiter
    except csv.Error:
        return max(",;\t|", key=header.count)


def clean_name(name: str) -> str:
    return name.replace("﻿", "").strip()


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by extension; the CSV separator and encoding come from its first line."""
    if path.endswith((".parquet", "/")) or ".parquet" in path.rsplit("/", 1)[-1]:
        df = spark.read.parquet(path)
    elif path.endswith(".csv"):
        raw = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16)).first()[0]
        line = bytes(raw).split(b"\n")[0]
        try:
            # a sample that is cut may end within a character
            bytes(raw)[: len(raw) - (4 if len(raw) == 1 << 16 else 0)].decode("utf-8")
            encoding = "utf-8"
        except UnicodeDecodeError:
            encoding = "iso-8859-1"
        df = spark.read.csv(path, header=True, sep=sniff_separator(line.decode("utf-8", "replace")), encoding=encoding, inferSchema=True, multiLine=True, quote='"', escape='"')
    else:
        raise ValueError(f"unknown extension: {path}")
    return df.toDF(*map(clean_name, df.columns))


def _decode(raw: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def scan_json_folder(spark: SparkSession, folder: str, mask: str) -> DataFrame:
    """(id, json, error) of files whose name matches the mask, group 1 being the id; the last path of an id wins.

    Unreadable text is repaired and else {}; an object with the key ``erro`` becomes an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    own = files.select("path", "content", F.regexp_extract(name, mask, 1).alias("id")).filter(name.rlike(mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for raw in batch.column(2).to_pylist():
                text = _decode(raw)
                try:
                    value = json.loads(text)
                except ValueError:
                    value = json_of_message(text)
                bad = isinstance(value, dict) and "erro" in value
                errors.append(str(value["erro"]) if bad else None)
                texts.append(None if bad else json.dumps(value, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["id", "path", "json", "error"])

    parsed = own.select("id", "path", "content").mapInArrow(run, "id string, path string, json string, error string")
    return parsed.groupBy("id").agg(F.max_by(F.struct("json", "error"), "path").alias("_v")).select("id", "_v.*")


def scan_text_folder(spark: SparkSession, folder: str, mask: str = "*.txt") -> DataFrame:
    """(chave, texto) of whole files by stem; blank texts are dropped."""
    own = spark.read.option("pathGlobFilter", mask).text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return own.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("chave"), F.col("value").alias("texto")).filter(~is_blank("texto"))


def scan_batch_table(df: DataFrame, key: str, text: str, ids: DataFrame | None = None) -> DataFrame:
    """(chave, texto) as text; null is "", blank rows are dropped, then the id filter."""
    own = df.select(F.trim(F.col(key).cast("string")).alias("chave"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("texto")).filter(~is_blank("texto"))
    return own if ids is None else own.join(ids.select(F.trim(F.col(ids.columns[0]).cast("string")).alias("chave")).distinct(), "chave", "left_semi")


LOG_SCHEMA = (
    "event string, step bigint, step_global bigint, epoch double, epoch_global double, elapsed_seconds double, etapa_alias string, etapa_index int, "
    "instancias_acumuladas bigint, tokens_acumulados bigint, train_loss double, eval_loss double, learning_rate double, ram_usada_gb double"
)


def scan_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """JSON lines; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def route(log: DataFrame) -> dict[str, DataFrame]:
    """Train, evaluation, global evaluation, stage and hardware rows of an event log."""
    event = F.col("event")
    return {
        "train": log.filter((event == "log") & F.col("train_loss").isNotNull()), "eval": log.filter((event == "evaluate") & F.col("eval_loss").isNotNull()),
        "eval_global": log.filter(event == "evaluate_global"), "stage": log.filter(event.isin("etapa_inicio", "etapa_fim")),
        "hardware": log.filter(F.col("ram_usada_gb").isNotNull() & ~F.coalesce(event, F.lit("")).isin("inicio", "fim")),
    }


def trainer_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """log_history split into train rows (loss) and evaluation rows (eval_loss)."""
    history = spark.read.schema("log_history array<struct<step:bigint,epoch:double,loss:double,eval_loss:double,learning_rate:double>>").json(path, multiLine=True).select(F.inline("log_history"))
    return history.filter("loss is not null").drop("eval_loss"), history.filter("eval_loss is not null").drop("loss")


def read_raters(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One parquet per rater with chave and resposta; the rater's number is the file's place in the list."""
    out = None
    for i, p in enumerate(paths, 1):
        df = spark.read.parquet(p)
        if missing := {"chave", "resposta"} - set(df.columns):
            raise ValueError(f"{p}: no {sorted(missing)}")
        df = df.withColumn("rater", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def open_data_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A list of objects or one object; a file that only says there are no entries is empty."""
    files = spark.read.text(path, wholetext=True).filter(~F.lower("value").contains("sem lançamentos"))
    body = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    return files.select(F.inline(F.from_json(body, f"array<struct<{schema}>>")))


def archives_of_catalogue(resources: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Resources that are ZIP files by name or format, of the years given by their name's prefix."""
    own = resources.filter(F.lower("name").endswith(".zip") | (F.upper("format") == "ZIP"))
    return own.filter(F.substring("name", 1, 4).isin([str(y) for y in years])) if years else own


def prompt_completion_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, prompt, completion) of JSON lines; ids count non-empty lines in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")))
    parsed = F.from_json("col", "prompt string, completion string")
    return lines.select(F.format_string("linha_%03d", F.col("pos") + 1).alias("id"), parsed["prompt"].alias("prompt"), parsed["completion"].alias("completion"))


def file_hash(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """(path, md5 of the content and a suffix)."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5(F.concat("content", F.lit(extra).cast("binary"))).alias("hash"))


def json_error_column(text: str) -> Column:
    return F.when(F.try_parse_json(text).isNull(), F.lit("JSON inválido"))
