"""Readers. Every one has a fixed schema and leaves filters and projections to the scan."""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom import schema, vocab
from graphloom.functions import text
from graphloom.functions.temporal import tolerant_timestamp
from graphloom.operators.graph import Graph
from graphloom.operators.series import every_nth, numbered, standardise_headers

NEWS = "Title string, Content string, Date string, URL string"


def read_news_json(spark: SparkSession, path: str) -> DataFrame:
    """News items from JSON: a list or one object, with or without a byte-order mark."""
    return spark.read.schema(NEWS).option("multiLine", True).json(path)


def read_news_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(NEWS).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.limit(limit) if limit else rows


def news_sections(news: DataFrame, order: str, skip: int = 0, limit: int | None = None, chars: int = 1200, title: str = "Title", content: str = "Content", date: str = "Date") -> DataFrame:
    """(seq, section): "[date] title, line break, content" of items with content, after ``skip`` and up to ``limit`` items."""
    rows = news.orderBy(order).offset(skip)
    rows = rows.limit(limit) if limit else rows
    rows = rows.where(F.trim(F.coalesce(F.col(content), F.lit(""))) != "")
    return rows.select(F.col(order).alias("seq"), F.concat(F.lit("["), F.coalesce(date, F.lit("")), F.lit("] "), F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(content, 1, chars)).alias("section"))


def read_prices(spark: SparkSession, paths: str | Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Price files, a file per ticker, the file's stem being the ticker; empty and broken files give no row."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(paths)
    rows = rows.withColumn("ticker", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1))
    rows = standardise_headers(rows)
    if skip:
        rows = rows.where(~F.upper("ticker").isin(*[s.upper() for s in skip]))
    numbers = [c for c in ("Open", "High", "Low", "Close", "Volume", "Adj Close", "Prev Close") if c in rows.columns]
    return rows.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in numbers}).withColumn("Date", F.to_date(tolerant_timestamp(F.col("Date"))))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("`Company Name` string, Symbol string, `ISIN Code` string, Industry string").option("header", True).csv(path)


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first worksheet as text, row by row; a missing cell is None."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(x.text or "" for x in s.iter(f"{main}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        out: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{main}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{main}c"):
                letters = re.sub(r"\d", "", c.get("r", ""))
                place = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                cells += [None] * (place + 1 - len(cells))
                value = c.find(f"{main}v")
                if c.get("t") == "inlineStr":
                    cells[place] = "".join(x.text or "" for x in c.iter(f"{main}t"))
                elif value is not None and value.text is not None:
                    cells[place] = shared[int(value.text)] if c.get("t") == "s" else value.text
            out.append(cells)
    return out


def read_excel(spark: SparkSession, path: str, required: Sequence[str] | None = None) -> DataFrame:
    """First worksheets as text columns, read by the executors, a file a task; the header is that of the first file. Rows lacking
    a required column are dropped, or lacking any if none is named. A sheet without rows gives no row."""
    files = spark.read.format("binaryFile").load(path)
    head = files.orderBy("path").limit(1).select("content").first()
    first = sheet_rows(bytes(head["content"])) if head else []
    header = [(h or f"_{i}").strip() for i, h in enumerate(first[0] if first else ["_0"])]
    spec = ", ".join(f"`{h}` string" for h in header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = sheet_rows(data)
                place = {(h or "").strip(): i for i, h in enumerate(rows[0] if rows else [])}
                cols = [[r[place[h]] if h in place and place[h] < len(r) else None for r in rows[1:]] for h in header]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=header)

    rows = files.select("content").mapInArrow(run, spec)
    return rows.dropna(subset=list(required)) if required else rows.dropna()


def index_rows(spark: SparkSession, path: str, every: int = 10, order: str = "Date") -> DataFrame:
    """Complete rows of index worksheets, every ``every``-th in order."""
    return every_nth(read_excel(spark, path), every, order)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Question rows from JSON lines, blank ones skipped."""
    return spark.read.schema("question string, gold_answer string, gold_path array<struct<rel:string,obj:string>>").json(path).where("question is not null")


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """A graph from one JSON document: nodes or entities; edges, links or relationships; ends by id or as objects."""
    node = "struct<id:string,name:string,label:string,type:string,confidence:double>"
    end = "struct<id:string,name:string>"
    edge = f"struct<id:string,source:string,target:string,type:string,predicate:string,name:string,subject:{end},object:{end},t_announce:string,t_effective:string>"
    doc = spark.read.schema(f"nodes array<{node}>, entities array<{node}>, edges array<{edge}>, links array<{edge}>, relationships array<{edge}>").option("multiLine", True).json(path)
    n = doc.select(F.explode(F.coalesce("nodes", "entities")).alias("n")).select("n.id", F.coalesce("n.name", "n.id").alias("name"), F.coalesce("n.label", "n.type").alias("label"), F.col("n.confidence").alias("confidence"))
    e = doc.select(F.posexplode(F.coalesce("edges", "links", "relationships")).alias("seq", "e"))
    src, dst, rel = F.coalesce("e.source", "e.subject.id"), F.coalesce("e.target", "e.object.id"), F.coalesce("e.type", "e.predicate", "e.name")
    edges = e.select(F.coalesce("e.id", F.concat_ws("|", src, rel, dst)).alias("eid"), src.alias("src"), dst.alias("dst"), rel.alias("rel"), F.col("e.t_announce").alias("t_announce"), F.col("e.t_effective").alias("t_effective"), F.lit("json").alias("source"), "seq")
    return Graph(n.select("id", "name", known_label("label").alias("label"), "confidence"), edges)


def known_label(c: str) -> Column:
    """A known node label, else Indicator."""
    return F.when(F.col(c).isin(*vocab.NODE_LABELS), F.col(c)).otherwise("Indicator")


def read_corpus(spark: SparkSession, pattern: str, longer_than: int = 10) -> DataFrame:
    """(file, text): lines of text files that are longer than that."""
    return spark.read.text(pattern).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("text")).where(F.length("text") > longer_than)


def first_available(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read and has a row; the last one stands whatever it holds."""
    for i, source in enumerate(sources):
        try:
            df = source()
            if i == len(sources) - 1 or df.limit(1).count():
                return df
        except Exception:
            if i == len(sources) - 1:
                raise
    raise ValueError("no source given")


def union_sources(sources: dict[str, DataFrame], chosen: Sequence[str] | None = None) -> DataFrame:
    """Sections (seq, section) of the chosen sources in their given order, with the source's name and rank."""
    out = None
    for rank, (name, rows) in enumerate(sources.items()):
        if chosen and name not in chosen:
            continue
        part = rows.select(F.lit(rank).alias("source_rank"), F.lit(name).alias("source"), F.col("seq").cast("long").alias("seq"), "section")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source chosen")
    return out


def with_ids(rows: DataFrame, prefix: str, *order: str) -> DataFrame:
    """Synthetic ids prefix_0, prefix_1, ... in order."""
    return numbered(rows, *order).withColumn("id", F.concat(F.lit(prefix + "_"), (F.col("rn") - 1).cast("string"))).drop("rn")


def headlines(items: DataFrame, order: str = "seq", top: int = 15, title: str = "title") -> DataFrame:
    """The first ``top`` items without removed or blank ones; those leave gaps in the ids, which count the first ``top``."""
    first = items.orderBy(order).limit(top)
    # over at most ``top`` rows
    n = first.withColumn("n", F.row_number().over(Window.orderBy(order)))
    t = F.trim(F.coalesce(F.col(title), F.lit("")))
    return n.where((t != "") & (t != "[Removed]"))


@dataclass
class CachedSource:
    """A source with a time to live: stale data serves when a refresh fails, and ``stub`` when there is none."""

    load: Callable[[], Any]
    stub: Any = None
    ttl: float = 300.0
    clock: Callable[[], float] = time.time

    def __post_init__(self) -> None:
        self._value, self._at = None, float("-inf")

    def get(self) -> Any:
        if self.clock() - self._at < self.ttl:
            return self._value
        try:
            self._value, self._at = self.load(), self.clock()
        except Exception:
            if self._value is None:
                return self.stub
        return self._value


def load_weights(path: str | None = None) -> dict[str, float]:
    """Score weights from a YAML or JSON file over the defaults; a missing file gives the defaults."""
    weights = dict(vocab.WEIGHTS)
    if path and Path(path).exists():
        raw = Path(path).read_text()
        try:
            import yaml

            given = yaml.safe_load(raw)
        except ImportError:
            given = json.loads(raw)
        weights |= {k: float(v) for k, v in (given or {}).items() if k in weights}
    return weights


# --- rows to sentences -----------------------------------------------------------------------------


def price_sentence(company: Column, ticker: Column, close: Column, volume: Column, date: Column) -> Column:
    return F.concat(company, F.lit(" (NSE: "), ticker, F.lit(") traded at a closing price of ₹"), close, F.lit(" with volume "), volume, F.lit(" on "), date, F.lit("."))


def history_sentence(ticker: Column, close: Column, date: Column) -> Column:
    return F.concat(ticker, F.lit(" had a closing price of ₹"), close, F.lit(" on "), date, F.lit(" according to historical records."))


def metadata_sentence(company: Column, symbol: Column, isin: Column, industry: Column) -> Column:
    return F.concat(company, F.lit(" (Symbol: "), symbol, F.lit(", ISIN: "), F.coalesce(isin, F.lit("N/A")), F.lit(") is listed on NSE/BSE in the "), industry, F.lit(" industry."))


def macro_sentence(year: Column, growth: Column, inflation: Column, index: Column, rate: Column) -> Column:
    return F.format_string("As of %d-01-01, India's GDP growth was %.2f%%, inflation was %.2f%%, the SENSEX closed at %.2f, and the USD/INR exchange rate was %.2f.", year, growth, inflation, index, rate)


def asian_sentence(n: Column, sensex: Column, strait: Column, kospi: Column, shanghai: Column, jasdaq: Column) -> Column:
    named = [("SENSEX", sensex), ("Straits Times Index", strait), ("KOSPI", kospi), ("Shanghai Composite", shanghai), ("JASDAQ", jasdaq)]
    parts = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("N/A"))) for k, v in named])
    return F.concat(F.lit("At observation "), n.cast("string"), F.lit(": "), parts, F.lit(". These Asian indices show co-movement across markets."))


def extracted_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.FACTS).json(path)


def parse_model_json(c: Column, json_schema: str) -> Column:
    """A model's answer as a struct, with or without a Markdown fence; null where it is no such JSON."""
    return F.from_json(text.strip_fence(c), json_schema)
