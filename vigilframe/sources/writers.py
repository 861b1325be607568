"""Sinks: partitioned appends, table replacement, report files."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS_PER_FILE = 2_000_000


def append_by_day(df: DataFrame, path: str, at: Column, stamp: str = "dt", max_rows: int = MAX_ROWS_PER_FILE) -> None:
    """Append to a day-partitioned table; files roll at a row limit."""
    (
        df.withColumn(stamp, F.to_date(at))
        .write.mode("append").option("maxRecordsPerFile", max_rows).partitionBy(stamp).parquet(path)
    )


def append_log(df: DataFrame, path: str, as_of: Column, max_rows: int = MAX_ROWS_PER_FILE) -> None:
    """Log sink: stamps ``at`` where it is missing, partitions by its day."""
    filled = F.coalesce(F.col("at"), as_of) if "at" in df.columns else as_of
    append_by_day(df.withColumn("at", filled), path, F.col("at"), max_rows=max_rows)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append").option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def log_document(df: DataFrame) -> DataFrame:
    """Evidence rows as log documents."""
    return df.select(
        "evidence_id", F.col("event_time").alias("at"), "source", "asset_id",
        F.to_json("normalized").alias("message"), "content_fingerprint",
    )


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Graph dump: node files, edge files and one metadata row with the counts."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    counts = nodes.agg(F.count(F.lit(1)).alias("node_count")).select("node_count", F.lit("n").alias("k"))
    both = counts.join(edges.agg(F.count(F.lit(1)).alias("edge_count")).withColumn("k", F.lit("n")), "k").drop("k")
    both.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def write_report(stats: DataFrame, path: str, title: str, period: str, limits: dict[str, int] | None = None) -> dict[str, str]:
    """Statistics as JSON files, and Markdown and HTML texts with a table per dimension.

    The tables hold one row per type, sector and actor, which the texts need on the driver; ``limits`` (by dimension) keeps the
    largest ones only.
    """
    from vigilframe.operators.report import summary_row, top_items

    limits = limits or {}
    stats = stats.persist()
    try:
        stats.write.mode("overwrite").json(f"{path}/statistics")
        head = summary_row(stats).first()
        lines = [f"# {title}", "", f"**Reporting period:** {period}", "", f"- **Total incidents:** {head['total']}", ""]
        body = [f"<h1>{html.escape(title)}</h1>", f"<p>{html.escape(period)}</p>"]
        for dimension in ("type", "sector", "actor"):
            rows = top_items(stats, dimension, limits.get(dimension)).collect()
            if not rows:
                continue
            lines += [f"## Incidents by {dimension}", "", "| Item | Incidents | Share |", "|---|---|---|"]
            body += [f"<h2>{dimension}</h2><table>"]
            for r in rows:
                share = f"{100.0 * r['incidents'] / max(head['total'], 1):.1f}%"
                lines.append(f"| {r['item']} | {r['incidents']} | {share} |")
                body.append(f"<tr><td>{html.escape(r['item'])}</td><td>{r['incidents']}</td><td>{share}</td></tr>")
            lines.append("")
            body.append("</table>")
        texts = {"markdown": "\n".join(lines), "html": "<html><body>" + "".join(body) + "</body></html>"}
        spark = stats.sparkSession
        for name, content in texts.items():
            spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
        return texts
    finally:
        stats.unpersist()


def report_entry(texts: dict[str, str], spark: SparkSession) -> DataFrame:
    """Audit payload of a report: the digest of its content."""
    return spark.createDataFrame([(texts["markdown"],)], "content string").select(
        F.lit("REPORT").alias("entry_type"), F.sha2("content", 256).alias("content_hash")
    )
