"""Stored scanner results: reading and writing (SRC-05..09, SNK-01..03)."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRUCTURAL = ["token_timeline", "context_flush", "human_intervention", "eval_setup"]
#: Columns that no table needs.
HEAVY = ["scan_events", "input", "transcript_messages"]


def newest_scan(spark: SparkSession, where: str) -> str:
    """SRC-07, SRT-06: the newest `scan_id=*` folder below a path, or the path itself if it is one. Listed through Hadoop, so any store will do."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if "scan_id=" in path.getName():
        return where
    found = [s for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("scan_id=")]
    if not found:
        raise ValueError(f"no scan in {where}")
    return max(found, key=lambda s: (s.getModificationTime(), s.getPath().getName())).getPath().toString()


def read_scan(spark: SparkSession, where: str, scanners: list[str]) -> dict[str, DataFrame]:
    """SRC-07: one table a scanner, without heavy columns; a scan without a structural scanner is refused."""
    missing = [s for s in STRUCTURAL if s not in scanners]
    if missing:
        raise ValueError(f"the scan lacks {', '.join(missing)}: scan again with them")
    out = {}
    for s in scanners:
        t = spark.read.parquet(f"{where}/{s}.parquet")
        out[s] = t.select(*[c for c in t.columns if c not in HEAVY])
    return out


def only(transcripts: DataFrame, ids: list[str]) -> DataFrame:
    """SRC-05: transcripts by id: the list reaches the scan as a pushed filter."""
    return transcripts.filter(F.col("transcript_id").isin(ids))


def with_headers(setup: DataFrame, headers: DataFrame) -> DataFrame:
    """SRC-06: header facts by source; a source without one has none."""
    return setup.join(headers, "source_uri", "left")


def write_scan(frames: dict[str, DataFrame], where: str) -> None:
    """SNK-01: results as a scan folder, each table once."""
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{where}/{name}.parquet")


@dataclass
class Results:
    """SNK-03: lazily built tables by name, and layers' tables."""

    frames: dict[str, DataFrame]
    layers: dict[str, DataFrame] = field(default_factory=dict)

    def views(self) -> list[str]:
        """Every table as a temporary view of its name, for Spark SQL."""
        for name, df in (self.frames | self.layers).items():
            df.createOrReplaceTempView(name)
        return [*self.frames, *self.layers]

    def of(self, transcript_id: str) -> Results:
        """FLT-04: the tables cut to one transcript."""
        cut = lambda d: {n: f.filter(F.col("transcript_id") == transcript_id) if "transcript_id" in f.columns else f for n, f in d.items()}
        return Results(cut(self.frames), cut(self.layers))


def html_pages(rows: DataFrame, title: str, size: int = 10_000) -> Iterator[str]:
    """SNK-02: index pages of aggregated rows, `size` to a page, each with the way on. Rows come to the driver one partition at a time."""
    names, head = rows.columns, escape(title)
    row = lambda r: "<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>"
    left = rows.toLocalIterator()
    page, now = 1, list(itertools.islice(left, size))
    while now or page == 1:
        after = list(itertools.islice(left, size))
        way = f'<p><a href="{page + 1}.html">next</a></p>' if after else ""
        yield f"<!doctype html><title>{head}</title><h1>{head}</h1><table><tr>{''.join(f'<th>{escape(n)}</th>' for n in names)}</tr>{''.join(map(row, now))}</table>{way}"
        page, now = page + 1, after


def html_index(rows: DataFrame, title: str, limit: int = 10_000) -> str:
    """SNK-02: an index of one page; more rows than a page holds are an error: write `html_pages`."""
    pages = list(itertools.islice(html_pages(rows, title, limit), 2))
    if len(pages) > 1:
        raise ValueError(f"the index has more than {limit} rows: write html_pages")
    return pages[0]


def load_spec(text: str) -> dict:
    """SRC-08, MSC-02: a rubric: phases and labels (a bare string is a label), the operational bucket, context, extra; others are refused."""
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml  # optional

        raw = yaml.safe_load(text)
    allowed = {"phases", "subagent_labels", "phase_ops_label", "context", "extra"}
    if extra := sorted(set(raw) - allowed):
        raise ValueError(f"unknown field(s) {extra}")
    entry = lambda x: {"label": x, "description": ""} if isinstance(x, str) else x
    out = {"phases": [entry(x) for x in raw.get("phases", [])], "subagent_labels": [entry(x) for x in raw.get("subagent_labels", [])], "context": raw.get("context", ""), "extra": raw.get("extra", {}), "phase_ops_label": raw.get("phase_ops_label")}
    for kind in ("phases", "subagent_labels"):
        for x in out[kind]:
            if "_".join(x["label"].lower().split()) != x["label"]:
                raise ValueError(f"{x['label']!r} must be written as its key, {'_'.join(x['label'].lower().split())!r}")
        if len({x["label"] for x in out[kind]}) < len(out[kind]):
            raise ValueError(f"{kind} repeats a label")
    if out["phase_ops_label"] and out["phase_ops_label"] not in {x["label"] for x in out["phases"] if x["description"]}:
        raise ValueError("phase_ops_label must name a phase with a description")
    return out


def vocabulary(spark: SparkSession, spec: dict) -> DataFrame:
    """VOT-13: declared labels with the operational bucket and none-of-the-above where they aren't declared: surface, label, description, reserved, ord."""
    rows = []
    for surface, kind, reserved in (("phases", "phases", [spec["phase_ops_label"] or "ops"]), ("subagents", "subagent_labels", ["none_of_the_above"])):
        own = [(surface, x["label"], x["description"], x["label"] in reserved) for x in spec[kind]]
        own += [(surface, r, "", True) for r in reserved if own and r not in {o[1] for o in own}]
        rows += [(*o, i) for i, o in enumerate(own)]
    return spark.createDataFrame(rows, "surface string, label string, description string, reserved boolean, ord int")
