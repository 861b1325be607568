"""Hash-chained logs, reviews, version chains, promotion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.operators.running import row_positions
from vigilframe.operators.tables import latest
from vigilframe.session import cut_lineage

# Entries of a leaf: what one task chains, and what one seal or one step of a hash tree covers. A power of two.
LEAF = 1024
# Most segments (a key, a number each) whose first entries are broadcast.
BROADCAST_SEGMENTS = 100_000


def entry_payload(columns: list[str]) -> Column:
    """The text of an entry that is hashed together with the previous hash."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def link_hash(prev: Column, payload: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(prev, F.lit("")), payload), 256)


def _linked(prev: str | None, text: str) -> str:
    return hashlib.sha256(((prev or "") + text).encode("utf-8")).hexdigest()


def _chain_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves one after the other: a row without a number brings the hash its leaf starts from, the entries follow in order."""
    prev = None
    for batch in batches:
        prevs, hashes = [], []
        for seq, payload, start in zip(*(batch.column(c).to_pylist() for c in ("seq", "payload", "start_hash"))):
            if seq is None:
                prev = start
                continue
            prevs.append(prev)
            prev = _linked(prev, payload)
            hashes.append(prev)
        kept = batch.filter(batch.column("seq").is_valid())
        columns = [kept.column(c) for c in kept.schema.names if c != "start_hash"]
        names = [c for c in kept.schema.names if c != "start_hash"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], [*names, "prev_hash", "entry_hash"])


def _chain_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seals of the keys one after the other, each key's in order; ``opens`` marks a key's first."""
    start = None
    for batch in batches:
        starts = []
        for opens, head, seal in zip(*(batch.column(c).to_pylist() for c in ("opens", "head_hash", "seal"))):
            start = head if opens else start
            starts.append(start)
            start = _linked(start, seal)
        names = [c for c in batch.schema.names if c not in ("opens", "head_hash", "seal")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(starts, pa.string())], [*names, "start_hash"])


def entry_digest() -> Column:
    """Digest of an entry's number and payload, whatever came before it."""
    return F.sha2(F.concat_ws("|", F.col("seq").cast("string"), F.col("payload")), 256)


def leaf_starts(rows: DataFrame, key: str, heads: DataFrame | None = None) -> DataFrame:
    """(key, segment, leaf, start_hash): the hash each leaf continues from.

    A leaf's seal covers the ordered digests of its entries (at most ``LEAF``), and the starts chain the seals: one short row per
    leaf goes through a task per key. ``heads`` (key, head_hash) gives the start of each key's first leaf.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("seq"), entry_digest().alias("digest"))))
    seals = rows.groupBy(key, "segment", "leaf").agg(
        F.sha2(F.array_join(F.transform(ordered, lambda e: e["digest"]), ""), 256).alias("seal")
    )
    if heads is not None:
        seals = seals.join(heads.select(key, "head_hash"), key, "left")
    else:
        seals = seals.withColumn("head_hash", F.lit(None).cast("string"))
    kind = rows.schema[key].dataType.simpleString()
    # Many keys share a task and a batch: a call per key would cost more than its few seals.
    opens = F.row_number().over(Window.partitionBy(key).orderBy("segment", "leaf")) == 1
    ordered = seals.select(key, "segment", "leaf", "seal", "head_hash", opens.alias("opens")).sortWithinPartitions(key, "segment", "leaf")
    return ordered.mapInArrow(_chain_starts, f"`{key}` {kind}, segment bigint, leaf bigint, start_hash string")


def chained(
    df: DataFrame, key: str, order: list[Column], period: Column, columns: list[str], log: DataFrame | None = None, leaf: int = LEAF
) -> DataFrame:
    """Append-ready log: seq, segment, leaf, payload, prev_hash and entry_hash per chain key.

    The entries of a chain in one ``period`` (a day, an hour: whole numbers that do not fall along ``order``) are a segment, cut
    into leaves of ``leaf`` entries. In a leaf each entry hashes its payload with the hash before it; a leaf starts from a seal over
    everything before it. So the rule is the same for any number of rows, leaves are built in parallel, and a task holds one batch.

    ``log``, what this function returned before, is continued: numbers go on, and entries of a period that the log already
    holds go on from its last hash. An entry of an earlier period counts to the last one of the log. The result holds the new
    entries only; built at once or in appends, a log is the same.
    """
    rows = df.withColumn("segment", period.cast("bigint"))
    if log is not None:
        last = log.groupBy(key).agg(
            F.max("segment").alias("_open"), F.max("seq").alias("_seq"), F.max_by("entry_hash", "seq").alias("_head"), F.max_by("leaf", "seq").alias("_leaf")
        )
        begun = log.groupBy(key, F.col("segment").alias("_open")).agg(F.min("seq").alias("_first"))
        last = cut_lineage(last.join(begun, [key, "_open"]))
        rows = rows.join(last.select(key, "_open", "_seq", "_first"), key, "left")
        rows = rows.withColumn("segment", F.greatest("segment", "_open"))
    rows = row_positions(rows, [key], [F.col("segment"), *order], F.col("segment")).withColumn("payload", entry_payload(columns))
    goes_on = F.when(F.col("segment") == F.col("_open"), F.col("_first")) if log is not None else F.lit(None).cast("bigint")
    rows = rows.select(key, (F.col("seq") + (F.coalesce("_seq", F.lit(0)) if log is not None else 0)).alias("seq"), "segment", "payload", goes_on.alias("_begun"))
    rows = cut_lineage(rows)  # read again below: by the leaves' numbers, the seals and the leaves
    first = rows.groupBy(key, "segment").agg(F.min(F.coalesce("_begun", "seq")).alias("_first"))
    rows = rows.drop("_begun").join(first, [key, "segment"])
    rows = rows.select(key, "seq", "segment", F.floor((F.col("seq") - F.col("_first")) / leaf).alias("leaf"), "payload")
    if log is None:
        starts = leaf_starts(rows, key)
    else:
        opened = log.join(last.select(key, F.col("_open").alias("segment"), F.col("_leaf").alias("leaf")), [key, "segment", "leaf"])
        heads = opened.groupBy(key).agg(F.min_by("prev_hash", "seq").alias("head_hash"))
        starts = leaf_starts(rows.unionByName(opened.select(rows.columns)), key, heads).join(last, key, "left")
        same = (F.col("segment") == F.col("_open")) & (F.col("leaf") == F.col("_leaf"))
        starts = starts.select(key, "segment", "leaf", F.when(same, F.col("_head")).otherwise(F.col("start_hash")).alias("start_hash"))
    # A leaf's start travels as a row before its entries, and a task goes through its leaves in order: neither a join nor a call per leaf.
    staged = rows.select(key, "seq", "segment", "leaf", "payload", F.lit(None).cast("string").alias("start_hash"))
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("seq", "payload")]
    staged = staged.unionByName(starts.select(key, "segment", "leaf", *none, "start_hash"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema.fields if f.name != "start_hash")
    ordered = staged.repartition(key, "segment", "leaf").sortWithinPartitions(key, "segment", "leaf", F.col("seq").asc_nulls_first())
    return ordered.mapInArrow(_chain_entries, schema + ", prev_hash string, entry_hash string")


def chain_faults(log: DataFrame, key: str, heads: DataFrame | None = None) -> DataFrame:
    """Every entry with its checks: own hash, and link to the entry before.

    Self equi-joins on the sequence number and the leaf; fully parallel.
    """
    before = log.select(
        key, (F.col("seq") + 1).alias("seq"), "segment", "leaf", F.col("entry_hash").alias("_prev")
    )
    firsts = leaf_starts(log.select(key, "seq", "segment", "leaf", "payload"), key, heads)
    joined = log.join(before, [key, "segment", "leaf", "seq"], "left").join(firsts, [key, "segment", "leaf"], "left")
    own = link_hash(F.col("prev_hash"), F.col("payload")) != F.col("entry_hash")
    broken = ~F.col("prev_hash").eqNullSafe(F.coalesce("_prev", "start_hash"))
    return joined.select(key, "seq", F.coalesce(own, F.lit(True)).alias("tampered"), broken.alias("broken_link"))


def _tree_part(key: tuple, nodes: pa.Table) -> pa.Table:
    """Binary hash tree over up to ``LEAF`` neighbouring nodes: each node with its path to the part's root.

    Two neighbours give the digest of both; a last node without a neighbour goes up as it is.
    """
    nodes = nodes.sort_by("place")
    level = nodes["digest"].to_pylist()
    at = list(range(len(level)))
    paths: list[list[dict]] = [[] for _ in level]
    while len(level) > 1:
        for path, i in zip(paths, at):
            if i ^ 1 < len(level):
                path.append({"hash": level[i ^ 1], "left": i % 2 == 1})
        level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    kind = pa.list_(pa.struct([("hash", pa.string()), ("left", pa.bool_())]))
    return nodes.append_column("path", pa.array(paths, kind)).append_column("root", pa.array([level[0]] * len(paths), pa.string()))


def inclusion_proofs(log: DataFrame, key: str) -> DataFrame:
    """(key, segment, seq, digest, path, root): each entry's path to the root of its segment's hash tree.

    ``log`` has the key, segment, seq (numbers without gaps in a segment) and payload. ``path`` lists the neighbours, bottom up, as (hash,
    left): with them the digest of the entry gives the root, one hash a step, so an entry is proved by as many hashes as the logarithm of
    its segment. The tree is built in parts of ``LEAF`` nodes, a part per task; their roots are the nodes of the next step.
    Few segments are broadcast to their entries, as a join by segment would bring a hot one into one task; numbers stay with their entries.
    """
    first = cut_lineage(log.groupBy(key, "segment").agg(F.min("seq").alias("_first")))
    first = F.broadcast(first) if first.count() <= BROADCAST_SEGMENTS else first
    rows = log.select(key, "segment", "seq", entry_digest().alias("digest")).join(first, [key, "segment"])
    rows = rows.select(key, "segment", "seq", (F.col("seq") - F.col("_first")).alias("place"), "digest")
    kind = log.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, segment bigint, part bigint, seq bigint, place bigint, digest string, path array<struct<hash: string, left: boolean>>, root string"
    proofs, nodes = None, rows.select(key, "segment", "seq", "place", "digest")
    while proofs is None or nodes.where("place > 0").limit(1).count():
        dealt = nodes.select(key, "segment", F.floor(F.col("place") / LEAF).alias("part"), "seq", "place", "digest")
        step = cut_lineage(dealt.groupBy(key, "segment", "part").applyInArrow(_tree_part, schema))
        if proofs is None:
            proofs = step.select(key, "segment", "seq", "digest", F.col("part").alias("up"), "path", "root")
        else:
            higher = step.select(key, "segment", F.col("place").alias("up"), F.col("part").alias("_up"), F.col("path").alias("_path"), F.col("root").alias("_root"))
            proofs = proofs.join(higher, [key, "segment", "up"])
            proofs = proofs.select(key, "segment", "seq", "digest", F.col("_up").alias("up"), F.concat("path", "_path").alias("path"), F.col("_root").alias("root"))
        nodes = step.select(key, "segment", F.lit(None).cast("bigint").alias("seq"), F.col("part").alias("place"), F.col("root").alias("digest")).distinct()
    return proofs.select(key, "segment", "seq", "digest", "path", "root")


def proves(digest: Column, path: Column, root: Column) -> Column:
    """Whether the path leads from the digest to the root."""
    step = lambda h, p: F.sha2(F.when(p["left"], F.concat(p["hash"], h)).otherwise(F.concat(h, p["hash"])), 256)
    return F.reduce(path, digest, step) == root


def chain_report(log: DataFrame, key: str) -> DataFrame:
    """Per chain: valid, entries and the first bad sequence number."""
    faults = chain_faults(log, key)
    bad = F.col("tampered") | F.col("broken_link")
    return faults.groupBy(key).agg(
        F.count(F.lit(1)).alias("entries"),
        F.min(F.when(bad, F.col("seq"))).alias("first_bad_seq"),
        (F.count_if(bad) == 0).alias("valid"),
    )


def role_weight(role: Column) -> Column:
    expr = None
    for name, weight in params.ROLE_WEIGHTS.items():
        hit = F.upper(role) == name
        expr = F.when(hit, F.lit(weight)) if expr is None else expr.when(hit, F.lit(weight))
    return expr.otherwise(F.lit(params.ROLE_WEIGHTS["UNKNOWN"]))


def consensus(votes: DataFrame, proposed: DataFrame, digits: int = 4) -> DataFrame:
    """Weighted agreement per decision with the proposed correction.

    ``votes``: decision_id, analyst_id, role, correction_type, seq; the last
    vote of an analyst counts. ``proposed``: decision_id, target_type.
    """
    last = latest(votes, ["decision_id", "analyst_id"], F.col("seq"))
    weighted = last.withColumn("weight", role_weight(F.col("role"))).join(proposed, "decision_id")
    agree = F.sum(F.when(F.upper("correction_type") == F.upper("target_type"), F.col("weight")).otherwise(F.lit(0.0)))
    share = F.round(agree / F.sum("weight"), digits)
    low_impact = F.upper(F.first("target_type")) == "CONFIRM"
    out = weighted.groupBy("decision_id", "target_type").agg(
        F.count(F.lit(1)).alias("voters"), share.alias("share"), low_impact.alias("low_impact")
    )
    score = F.when(F.col("low_impact"), F.lit(1.0)).otherwise(F.col("share"))
    return out.select(
        "decision_id", "target_type", "voters", score.alias("consensus"),
        F.when(score >= params.CONSENSUS_THRESHOLD, "APPLIED").otherwise("PENDING_CONSENSUS").alias("outcome"),
    )


SUFFIX = {"MODIFY": "-CORR", "REVOKE": "-REV", "ESCALATE": "-ESC"}


def version_chain(corrections: DataFrame) -> DataFrame:
    """Versions of each decision: id suffixes add up, each version names its predecessor.

    ``corrections``: root_id, seq, correction_type, action_taken (of the root).
    The id of version n holds all n suffixes, so one root's history is short.
    """
    suffix = None
    for name, text in SUFFIX.items():
        hit = F.col("correction_type") == name
        suffix = F.when(hit, text) if suffix is None else suffix.when(hit, text)
    window = Window.partitionBy("root_id").orderBy("seq")
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    out = corrections.withColumn("_suffix", suffix).where("_suffix IS NOT NULL")
    out = out.withColumn("decision_id", F.concat(F.col("root_id").cast("string"), F.array_join(F.collect_list("_suffix").over(so_far), "")))
    out = out.withColumn("version", (F.row_number().over(window) + 1).cast("bigint"))
    out = out.withColumn(
        "supersedes", F.coalesce(F.lag("decision_id").over(window), F.col("root_id").cast("string"))
    )
    verb = F.when(F.col("correction_type") == "REVOKE", "REVOKED:").when(F.col("correction_type") == "ESCALATE", "ESCALATED:").otherwise("MODIFIED:")
    return out.withColumn("action_taken", F.concat(verb, F.col("action_taken"))).drop("_suffix")


def promotion(metrics: DataFrame, ratio: float = params.PROMOTION_RATIO) -> DataFrame:
    """Per model: promoted when every shadow metric reaches its share of the live one.

    ``metrics``: model, metric, shadow, live.
    """
    required = F.col("live") * F.lit(ratio)
    short = F.col("shadow") < required
    reason = F.format_string("%s: shadow=%.4f < %.4f", "metric", "shadow", required)
    return metrics.groupBy("model").agg(
        (~F.bool_or(short)).alias("promoted"),
        F.array_join(F.array_sort(F.collect_list(F.when(short, reason))), "; ").alias("reasons"),
    )


def audit_statistics(log: DataFrame, memories: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """One row: log entries, memories, whether every chain holds, promotions and rejections of shadow models.

    ``history``: promoted BOOLEAN; a null counts as rejected.
    """
    chains = chain_report(log, key).agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("audit_log_entries"), F.coalesce(F.bool_and("valid"), F.lit(True)).alias("chain_valid"))
    kept = memories.agg(F.count("*").alias("cognitive_memory_count"))
    won = F.coalesce("promoted", F.lit(False))
    shadows = history.agg(F.count_if(won).alias("shadow_promotions"), F.count_if(~won).alias("shadow_rejections"))
    return chains.crossJoin(kept).crossJoin(shadows)  # one row each


def excerpts(log: DataFrame, columns: list[str], at: Column, limit: int | None = None) -> DataFrame:
    """The named columns of the log, newest first; all rows unless a limit is given."""
    newest = log.orderBy(at.desc())
    return (newest if limit is None else newest.limit(limit)).select(*columns)
