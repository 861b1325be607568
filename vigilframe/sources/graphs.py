"""Graph readers: every source becomes node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions import records
from vigilframe.session import small_side

GRAPH_SCHEMA = (
    "metadata struct<base_date:string,attack_path:array<string>>,"
    "nodes array<struct<id:string,type:string,criticality:double,label:string,"
    "features:struct<cpu_load:double,network_traffic_mbps:double,open_connections:double>>>,"
    "edges array<struct<`from`:string,`to`:string,protocol:string,weight:double,timestamps:array<string>>>"
)


def graph_tables(doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a parsed graph document; edges keep their ordinal."""
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    edges = doc.select(F.posexplode("edges").alias("ordinal", "e")).select(
        F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.protocol").alias("protocol"),
        F.coalesce("e.weight", F.lit(0.5)).alias("weight"), F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("e.timestamps").alias("timestamps"),
    )
    return nodes, edges


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return graph_tables(spark.read.schema(GRAPH_SCHEMA).json(path, multiLine=True))


def temporal_edges(edges: DataFrame, base: Column) -> DataFrame:
    """(src, dst, seconds): one row per edge instant, floored at the base time."""
    rows = edges.select("src", "dst", F.explode("timestamps").alias("at"))
    at = F.try_to_timestamp("at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return rows.where(at.isNotNull()).select("src", "dst", records.elapsed_seconds(at, base).alias("seconds"))


def node_table(df: DataFrame, columns: dict[str, str], source: str) -> DataFrame:
    """Distinct (id, label, source) of several id columns, from one pass."""
    ids = F.array(*[F.struct(F.col(c).cast("string").alias("id"), F.lit(label).alias("label")) for c, label in columns.items()])
    return df.select(F.explode(ids).alias("n")).select("n.id", "n.label", F.lit(source).alias("source")).distinct()


def capped(df: DataFrame, per: list[str], order: list[Column], limit: int | None) -> DataFrame:
    """The first rows of each file or type; the cap is the importer's own parameter."""
    if limit is None:
        return df
    rank = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= limit).drop("_r")


def split_fields(lines: DataFrame, names: list[str], column: str = "value") -> DataFrame:
    """Comma-separated lines with at least ``len(names)`` fields."""
    parts = F.split(F.trim(column), ",")
    return lines.where((F.trim(column) != "") & (F.size(parts) >= len(names))).select(
        "*", *[parts[i].alias(n) for i, n in enumerate(names)]
    )


def lateral_movement(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """time,user,src,dst lines -> sign-in and lateral-movement edges and three node sets."""
    rows = split_fields(lines, ["time", "user", "src", "dst"], column)
    none = F.lit(None)
    edge = lambda src, dst, relation, user, label: F.struct(
        F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(relation).alias("relation"),
        F.col("time").try_cast("bigint").alias("time_sec"), user.cast("string").alias("user"), label.cast("int").alias("label"),
    )
    both = F.array(edge("user", "src", "LOGGED_IN_FROM", none, none), edge("src", "dst", "RED_TEAM_LATERAL", F.col("user"), F.lit(1)))
    nodes = node_table(rows, {"src": "Computer", "dst": "Computer", "user": "User"}, "LANL")
    return nodes, rows.select(F.explode(both).alias("e")).select("e.*")


FLOW_TEXT_FIELDS = ["time", "duration", "src", "src_port", "dst", "dst_port", "proto", "packets", "bytes"]


def flow_text(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Nine-field flow lines -> FLOW edges (benign) and computer nodes."""
    rows = split_fields(lines, FLOW_TEXT_FIELDS, column)
    edges = rows.select(
        "src", "dst", F.lit("FLOW").alias("relation"), F.col("time").try_cast("bigint").alias("time_sec"),
        F.col("proto").alias("protocol"), F.lit(0).alias("label"),
    )
    return node_table(rows, {"src": "Computer", "dst": "Computer"}, "LANL_Flow"), edges


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate among the headers, ignoring case and outer blanks."""
    known = {c.strip().lower(): c for c in columns}
    return next((known[c.strip().lower()] for c in candidates if c.strip().lower() in known), None)


SRC_HEADERS = ["Src IP", "src_ip", "Source IP", "Source_IP"]
DST_HEADERS = ["Dst IP", "dst_ip", "Destination IP", "Destination_IP"]
LABEL_HEADERS = ["Label", "label", "Attack"]
PROTOCOL_HEADERS = ["Protocol", "protocol"]


def flow_table_edges(df: DataFrame, relation: str, source: str, benign: list[str] | None = None, default_protocol: str = "TCP") -> tuple[DataFrame, DataFrame]:
    """Labelled flow table -> edges with label 0/1 and address nodes.

    Headers are looked up among candidates; rows without both ends are dropped.
    """
    benign = benign or params.BENIGN_WORDS
    pick = lambda names: find_column(df.columns, names)
    src, dst, label, proto = pick(SRC_HEADERS), pick(DST_HEADERS), pick(LABEL_HEADERS), pick(PROTOCOL_HEADERS)
    if src is None or dst is None:
        raise ValueError(f"no address columns among {df.columns}")
    text = lambda c, d: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit(d)) if c else F.lit(d)
    rows = df.select(
        text(src, "").alias("src"), text(dst, "").alias("dst"), F.lit(relation).alias("relation"),
        text(proto, default_protocol).alias("protocol"),
        F.when(F.lower(text(label, "benign")).isin(benign), 0).otherwise(1).alias("label"),
        F.lit(source).alias("source"),
    ).where("src <> '' AND dst <> ''")
    return node_table(rows, {"src": "IP", "dst": "IP"}, source), rows


def read_flow_directory(spark: SparkSession, path: str, relation: str, source: str, limit_per_file: int | None = None, benign=None):
    """All CSV files of a directory; an optional cap per file in reading order."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if limit_per_file is not None:
        at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
        df = capped(at, ["_file"], [F.col("_at")], limit_per_file).drop("_file", "_at")
    return flow_table_edges(df, relation, source, benign)


def sensor_chain(df: DataFrame, row_id: str, sensors: list[str], label: Column) -> tuple[DataFrame, DataFrame]:
    """Wide sensor rows -> edges between consecutive readable sensors of a row.

    The chain of one row is built inside the row, so nothing is shuffled.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(f"`{s}`").cast("string").try_cast("double").alias("value")) for s in sensors])
    readable = F.filter(cells, lambda c: c["value"].isNotNull())
    base = df.select(F.col(row_id).alias("row_id"), label.alias("label"), readable.alias("r"))
    pairs = F.zip_with(F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", 2, F.greatest(F.size("r"), F.lit(1))), lambda a, b: F.struct(
        F.concat(F.lit("sensor_"), a["sensor"]).alias("src"), F.concat(F.lit("sensor_"), b["sensor"]).alias("dst"), b["value"].alias("value")))
    edges = base.select("row_id", "label", F.explode(pairs).alias("p")).select("row_id", "p.src", "p.dst", "p.value", "label", F.lit("SENSOR_READING").alias("relation"))
    nodes = base.select(F.explode("r").alias("c")).select(F.concat(F.lit("sensor_"), F.col("c.sensor")).alias("id"), F.lit("OTSensor").alias("label")).distinct()
    return nodes, edges


STIX_SCHEMA = (
    "objects array<struct<type:string,id:string,name:string,description:string,source_ref:string,target_ref:string,"
    "relationship_type:string,external_references:array<struct<source_name:string,external_id:string>>>>"
)


def stix_tables(objects: DataFrame, order: str, limit: int | None = None, description_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of STIX objects.

    A relationship is kept only when both ends became nodes. ``limit`` keeps the first primary types in bundle order and
    ``description_chars`` the begin of descriptions, as the importer did; by default everything is kept.
    """
    from vigilframe.operators.graph import known_edges

    labels = F.create_map(*[F.lit(x) for k, v in params.STIX_LABELS.items() for x in (k, v[0])])
    primary = [k for k, v in params.STIX_LABELS.items() if v[1]]
    typed = objects.withColumn("label", F.try_element_at(labels, F.col("type"))).where("label IS NOT NULL")
    first = typed.where(F.col("type").isin(primary))
    first = first if limit is None else first.orderBy(order).limit(limit)
    told = F.coalesce("description", F.lit(""))
    rest = typed.where(~F.col("type").isin(primary))
    nodes = first.unionByName(rest).select(
        "id", "label", F.coalesce("name", "id").alias("name"),
        (told if description_chars is None else F.substring(told, 1, description_chars)).alias("description"),
        F.when(F.col("type") == "attack-pattern", records.mitre_id(F.col("external_references"))).otherwise(F.lit("")).alias("mitre_id"),
    )
    links = objects.where("type = 'relationship'").select(
        F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"),
        F.regexp_replace(F.upper(F.coalesce("relationship_type", F.lit("RELATES_TO"))), "-", "_").alias("relation"),
    )
    return nodes, known_edges(links, nodes)


def read_stix(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    doc = spark.read.schema(STIX_SCHEMA).json(path, multiLine=True)
    objects = doc.select(F.posexplode("objects").alias("pos", "o")).select("pos", "o.*")
    return stix_tables(objects, "pos", limit)


def positions(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows of a table that was just read, from 0: by file name, then by place in the file.

    The reader lists splits by size, so a split is known by its file and first byte. A table of rows per split, one row each,
    gives every split its offset; rows keep the order in which their split was read. Nothing else is sorted.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    tagged = df.select("*", at.alias("_split"), F.monotonically_increasing_id().alias("_id"))
    sizes = tagged.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_split", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = tagged.join(small_side(offsets), "_split")
    return placed.withColumn(name, F.col("_offset") + F.col("_id") - F.col("_first")).drop("_id", "_split", "_first", "_offset")


def zipped_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two tables, each read from files, row by row: the n-th row in file order of one with that of the other.

    Select from a table only after it is numbered, or keep the file metadata in reach. A narrow file is small for its rows, so its size
    says nothing about a broadcast: the join is always a merge join.
    """
    return positions(left).join(positions(right).hint("merge"), "_row").drop("_row")


PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1}


def benign_split(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(benign, attack) rows of a labelled training set."""
    benign = F.upper(F.trim(F.coalesce(F.col(label).cast("string"), F.lit("")))) == "BENIGN"
    return df.where(benign), df.where(~benign)


def training_flows(data: DataFrame, labels: DataFrame) -> DataFrame:
    """Data file and label file zipped by position; protocol numbers and total bytes."""
    rows = zipped_by_position(data, labels)
    numbers = F.create_map(*[F.lit(x) for kv in PROTOCOL_NUMBERS.items() for x in kv])
    out = rows.withColumn("protocol", F.coalesce(F.try_element_at(numbers, F.lower("proto")), F.col("proto").try_cast("int"), F.lit(0)))
    return out.withColumn("bytes", F.coalesce(F.col("sbytes").try_cast("double"), F.lit(0.0)) + F.coalesce(F.col("dbytes").try_cast("double"), F.lit(0.0)))
