"""Incident statistics, trends, recommendations and report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import records


def in_period(df: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    """Rows within the period; an end date includes its last second."""
    return df.where(F.col(at).between(start, end))


def report_date(text: Column) -> Column:
    """A date in any of the accepted spellings."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd")]
    return F.coalesce(*tries).cast("date")


def in_sector(incidents: DataFrame, assets: DataFrame, sector: str | None = None) -> DataFrame:
    """Incidents with the sector of their asset, optionally only one sector."""
    out = incidents.join(assets.select("asset_id", F.col("sector").alias("_s")), "asset_id", "left")
    out = out.withColumn("sector", F.coalesce("_s", F.lit("Unknown"))).drop("_s")
    return out.where(F.col("sector") == sector) if sector is not None else out


def statistics(incidents: DataFrame) -> DataFrame:
    """(dimension, item, incidents): counts by type, sector, actor and technique.

    ``incidents``: chain ARRAY<STRING>, sector, actor. One pass: each incident is
    exploded into its few counted items and all dimensions share one aggregate.
    """
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("item"))
    chain = F.coalesce("chain", F.array().cast("array<string>"))
    items = F.concat(
        F.array(
            pair("total", F.lit("all")),
            pair("type", records.technique_category(F.col("chain"))),
            pair("sector", F.coalesce("sector", F.lit("Unknown"))),
        ),
        F.when(F.col("actor").isNotNull(), F.array(pair("actor", F.col("actor")))).otherwise(F.array().cast("array<struct<dimension:string,item:string>>")),
        F.transform(chain, lambda t: pair("technique", t)),
    )
    return incidents.select(F.explode(items).alias("i")).groupBy("i.dimension", "i.item").agg(F.count(F.lit(1)).alias("incidents"))


def top_items(stats: DataFrame, dimension: str, limit: int | None = None) -> DataFrame:
    ranked = stats.where(F.col("dimension") == dimension).orderBy(F.desc("incidents"), "item")
    return ranked if limit is None else ranked.limit(limit)


def trend(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Change per type and in total, with the significance flags (20 % total, 30 % type)."""
    kept = F.col("dimension").isin("total", "type")
    both = (
        current.where(kept).withColumn("now", F.col("incidents")).withColumn("before", F.lit(0).cast("bigint"))
        .unionByName(previous.where(kept).withColumn("before", F.col("incidents")).withColumn("now", F.lit(0).cast("bigint")))
        .groupBy("dimension", "item").agg(F.sum("now").alias("now"), F.sum("before").alias("before"))
    )
    change = F.col("now") - F.col("before")
    pct = F.when(F.col("before") > 0, change / F.col("before") * 100).otherwise(F.lit(0.0))
    return both.select(
        "dimension", "item", "now", "before", change.alias("change"), F.round(pct, 1).alias("change_pct"),
        ((F.col("before") > 0) & (F.abs(pct) >= F.when(F.col("dimension") == "total", 20).otherwise(30))).alias("significant"),
    )


def top_shares(stats: DataFrame, dimension: str = "type", limit: int = 5) -> DataFrame:
    """(item, incidents, share_pct) of the largest items, for a trend without a previous period; the share is of the total, 0 without one."""
    total = stats.where("dimension = 'total'").agg(F.coalesce(F.sum("incidents"), F.lit(0)).alias("_total"))  # one row
    pct = F.when(F.col("_total") > 0, F.col("incidents") / F.col("_total") * 100).otherwise(F.lit(0.0))
    return top_items(stats, dimension, limit).join(F.broadcast(total), how="left").select("item", "incidents", F.round(pct, 1).alias("share_pct"))


def recommendations(stats: DataFrame, limit: int | None = None) -> DataFrame:
    """(rule, priority, mitigation, incidents) of the rules that hold."""
    count = lambda d, i: F.coalesce(F.sum(F.when((F.col("dimension") == d) & (F.col("item") == i), F.col("incidents"))), F.lit(0))
    row = stats.agg(
        F.greatest(count("total", "all"), F.lit(1)).alias("total"),
        count("type", "Phishing").alias("phishing"),
        count("type", "Ransomware").alias("ransomware"),
        count("type", "Unauthorized Access").alias("access"),
        count("technique", "T1190").alias("exploits"),
    )
    rule = lambda cond, name, priority, mitigation, n: F.when(
        cond, F.struct(F.lit(name).alias("rule"), F.lit(priority).alias("priority"), F.lit(mitigation).alias("mitigation"), n.alias("incidents"))
    )
    c = F.col
    rules = F.filter(
        F.array(
            rule(c("phishing") / c("total") > 0.3, "email_training", "HIGH", "M1017", c("phishing")),
            rule(c("ransomware") > 0, "backup_recovery", "CRITICAL", "M1053", c("ransomware")),
            rule(c("access") > 2, "multi_factor", "HIGH", "M1032", c("access")),
            rule(c("exploits") >= 3, "patch_management", "HIGH", "M1051", c("exploits")),
        ),
        lambda r: r.isNotNull(),
    )
    general = F.array(F.struct(F.lit("keep_monitoring").alias("rule"), F.lit("MEDIUM").alias("priority"), F.lit("M1031").alias("mitigation"), c("total").alias("incidents")))
    picked = F.when(F.size(rules) > 0, rules).otherwise(general)
    picked = picked if limit is None else F.slice(picked, 1, limit)
    return row.select(F.explode(picked).alias("r")).select("r.*")


def markdown_table(stats: DataFrame, dimension: str, limit: int | None = None) -> DataFrame:
    """One row: a Markdown table of the dimension, largest first."""
    total = F.sum(F.when(F.col("dimension") == "total", F.col("incidents")))
    whole = stats.agg(total.alias("t")).first()[0] or 0
    top = top_items(stats, dimension, limit)
    line = F.format_string("| %s | %d | %.1f%% |", "item", "incidents", F.col("incidents") * F.lit(100.0) / F.lit(max(whole, 1)))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("incidents")).alias("n"), F.col("item"), line.alias("line"))))
    return top.agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("body"))


def summary_row(stats: DataFrame) -> DataFrame:
    """One row: total, the top type and sector and their shares."""
    best = lambda d: F.max_by(F.col("item"), F.when(F.col("dimension") == d, F.struct(F.col("incidents"), F.col("item"))))
    most = lambda d: F.max(F.when(F.col("dimension") == d, F.col("incidents")))
    total = F.coalesce(F.sum(F.when(F.col("dimension") == "total", F.col("incidents"))), F.lit(0))
    out = stats.agg(
        total.alias("total"), best("type").alias("top_type"), most("type").alias("top_type_incidents"),
        best("sector").alias("top_sector"), most("sector").alias("top_sector_incidents"),
    )
    return out.withColumn("top_type_pct", F.when(F.col("total") > 0, F.round(F.col("top_type_incidents") * 100 / F.col("total"), 1)))


def telemetry_counters(counts: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """(metric, value) rows, one single-pass aggregate per source table.

    ``counts`` maps a metric to its table and an optional condition.
    """
    by_table: dict[int, tuple[DataFrame, list]] = {}
    for name, (df, condition) in counts.items():
        _, metrics = by_table.setdefault(id(df), (df, []))
        metrics.append((name, condition))
    out = None
    for df, metrics in by_table.values():
        row = df.agg(*[(F.count(F.lit(1)) if c is None else F.count_if(c)).alias(n) for n, c in metrics])
        long = row.unpivot([], [n for n, _ in metrics], "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def coverage_pct(counters: DataFrame) -> DataFrame:
    """One row of the counters plus the share of decisions taken without a human."""
    get = lambda n: F.coalesce(F.max(F.when(F.col("metric") == n, F.col("value"))), F.lit(0))
    names = [
        "total_ingested", "total_quarantined", "total_flagged", "total_decisions", "human_reviewed",
        "total_corrections", "security_events",
    ]
    row = counters.agg(*[get(n).alias(n) for n in names])
    auto = F.col("total_decisions") - F.col("human_reviewed")
    return row.withColumn(
        "coverage_pct",
        F.when(F.col("total_decisions") > 0, F.round(F.round(auto / F.col("total_decisions"), 4) * 100, 1)).otherwise(F.lit(0.0)),
    )


def timeline(events: DataFrame, incident: str, order: list[Column], bucket: Column | None = None, step_seconds: int = 15) -> DataFrame:
    """Add ``position`` and ``offset_seconds`` per incident."""
    from vigilframe.operators.running import row_positions

    placed = row_positions(events, [incident], order, bucket, "position")
    return placed.withColumn("offset_seconds", F.col("position") * step_seconds)


def quick_summary(stats: DataFrame, actors: int = 5) -> DataFrame:
    """One row: total, most frequent type, and the names of the most frequent actors, largest first."""
    actor = F.when(F.col("dimension") == "actor", F.struct((-F.col("incidents")).alias("n"), F.col("item")))
    ranked = F.slice(F.array_sort(F.collect_list(actor)), 1, actors)  # one entry per actor
    best = F.max_by(F.col("item"), F.when(F.col("dimension") == "type", F.struct(F.col("incidents"), F.col("item"))))
    total = F.coalesce(F.sum(F.when(F.col("dimension") == "total", F.col("incidents"))), F.lit(0))
    return stats.agg(total.alias("total"), best.alias("top_type"), F.transform(ranked, lambda r: r["item"]).alias("top_actors"))


def dashboard(runs: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: quarantined, flagged and clean runs, assets hit, and critical assets among them.

    ``runs``: asset_id, outcome. ``assets``: asset_id, criticality. An asset is hit by a run that is not clean.
    """
    per = runs.groupBy("asset_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("quarantined", "flagged", "clean")])
    known = per.join(assets.select("asset_id", "criticality"), "asset_id", "left")
    hit = F.col("asset_id").isNotNull() & (F.col("quarantined") + F.col("flagged") > 0)
    return known.agg(
        *[F.coalesce(F.sum(o), F.lit(0)).alias(o) for o in ("quarantined", "flagged", "clean")],
        F.count_if(hit).alias("assets_hit"), F.count_if(hit & (F.col("criticality") == "CRITICAL")).alias("crown_jewels_hit"),
    )
