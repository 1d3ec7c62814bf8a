"""Sources: tables of a folder, text documents of a directory, saved matrices and caches."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators.relations import filled_down
from spanloom.operators.units import document_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """[S5] Whole text files of a directory: ``doc``, ``path``, ``modified``, ``length``, ``text``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(T.document_name(F.col("path")).alias("doc"), "path", F.col("modificationTime").alias("modified"), "length", F.decode("content", "UTF-8").alias("text"))


def parsed(files: DataFrame, parser: Callable[[bytes], list[tuple[int, str]]] | None = None, backend: str = "pypdf") -> tuple[DataFrame, DataFrame]:
    """[S1, S4, S16] Pages of binary files and, apart from them, the files that could not be parsed.

    ``files`` has ``doc`` and ``content``. The parser gives page numbers and texts of a file's bytes;
    without one, ``backend`` is imported, which this box lacks, so its absence is an error row.
    """

    def pages(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for doc, content in zip(frame["doc"], frame["content"], strict=True):
                try:
                    parse = parser
                    if parse is None:
                        reader = importlib.import_module(backend).PdfReader
                        parse = lambda data: [(i + 1, p.extract_text()) for i, p in enumerate(reader(data).pages)]  # noqa: B023, E731
                    rows += [(doc, n, text, None) for n, text in parse(bytes(content))]
                except Exception as e:  # noqa: BLE001
                    rows.append((doc, None, None, repr(e)))
            yield pd.DataFrame(rows, columns=["doc", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    out = files.select("doc", "content").mapInPandas(pages, "doc string, page_number int, text string, error string")
    return out.filter("error is null").drop("error"), out.filter("error is not null").select("doc", "error")


def document_kinds(pages: DataFrame, errors: DataFrame | None = None, first: int = 3) -> DataFrame:
    """[S5] Documents with their number of ``pages`` and the ``doc_type`` that their first pages show; ``unknown`` for those in ``errors``, without pages."""
    early = pages.groupBy("doc").agg(F.count("*").alias("pages"), F.slice(F.sort_array(F.collect_list(F.when(F.col("page_number") <= first, F.struct("page_number", "text")))), 1, first).alias("early"))
    shown = early.select("doc", "pages", F.array_join(F.transform("early", lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("text"))
    kinds = shown.select("doc", "pages").join(document_type(shown).select("doc", "doc_type"), "doc")
    if errors is None:
        return kinds
    lost = errors.select("doc").distinct().join(kinds, "doc", "left_anti")
    return kinds.unionByName(lost.select("doc", F.lit(0).cast("long").alias("pages"), F.lit("unknown").alias("doc_type")))


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """[S1, N19] Page texts after :func:`spanloom.functions.text.page_text`."""
    return pages.withColumn("text", T.page_text(F.col("text")))


def saved_matrix(spark: SparkSession, path: str) -> DataFrame:
    """[S6] A saved backward matrix: merged cells filled down, rows without a reference left out."""
    rows = spark.read.parquet(path)
    for column in ("downstream_id", "downstream_content"):
        rows = filled_down(rows, ["downstream_doc"], ["row_no"], column)
    return rows.filter(F.coalesce("upstream_ref", F.lit("")) != "")


def verdict_cache(spark: SparkSession, path: str) -> DataFrame:
    """[S11] Cached answers, the last written for each key; empty if there are none."""
    try:
        found = spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - no cache yet
        return spark.createDataFrame([], "cache_key string, answer string")
    return found.groupBy("cache_key").agg(F.max_by("answer", "written").alias("answer"))
