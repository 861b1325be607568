"""Flow features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions.records import bound

RAW_FEATURES = [
    "bytes", "src_port", "dst_port", "flow_duration", "fwd_packets", "bwd_packets",
    "protocol_tcp", "protocol_udp", "protocol_icmp", "status_code", "hour_of_day", "day_of_week",
    "is_off_hours", "is_night", "port_entropy", "byte_rate", "packet_ratio",
    "is_privileged_port", "is_high_port", "connection_density",
]


def number(column: Column, default: float = 0.0) -> Column:
    """Numeric meaning of a text field; anything unreadable is the default."""
    return F.coalesce(column.try_cast("double"), F.lit(default))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def raw_features(rec: dict[str, Column]) -> dict[str, Column]:
    """The 20 serving-side features. ``rec`` maps canonical names to columns."""
    get = lambda name: number(rec.get(name, F.lit(None)))
    size, src, dst = get("bytes"), get("src_port"), get("dst_port")
    duration, fwd, bwd = get("flow_duration"), get("fwd_packets"), get("bwd_packets")
    proto = F.lower(F.coalesce(rec.get("protocol", F.lit(None)).cast("string"), F.lit("")))
    proto_number = get("protocol")
    ts = rec.get("timestamp", F.lit(None).cast("timestamp_ntz"))
    hour, weekday = F.hour(ts).cast("double"), F.weekday(ts).cast("double")
    known = ts.isNotNull()
    return {
        "bytes": size,
        "src_port": src,
        "dst_port": dst,
        "flow_duration": duration,
        "fwd_packets": fwd,
        "bwd_packets": bwd,
        "protocol_tcp": flag(proto.isin("tcp", "6") | (proto_number == 6)),
        "protocol_udp": flag(proto.isin("udp", "17") | (proto_number == 17)),
        "protocol_icmp": flag(proto.isin("icmp", "1") | (proto_number == 1)),
        "status_code": get("status"),
        "hour_of_day": F.coalesce(hour, F.lit(12.0)),
        "day_of_week": F.coalesce(weekday, F.lit(2.0)),
        "is_off_hours": flag(known & ((hour >= 18) | (hour < 9))),
        "is_night": flag(known & ((hour >= 23) | (hour < 6))),
        "port_entropy": F.abs(src - dst) / F.greatest(src + dst, F.lit(1.0)),
        "byte_rate": F.when(duration > 0, size / F.greatest(duration / F.lit(1e6), F.lit(0.001))).otherwise(F.lit(0.0)),
        "packet_ratio": fwd / F.greatest(fwd + bwd, F.lit(1.0)),
        "is_privileged_port": flag((dst < 1024) & (dst > 0)),
        "is_high_port": flag(src > 49152),
        "connection_density": fwd * bwd,
    }


def scaled_features(rec: dict[str, Column]) -> dict[str, Column]:
    """The 20 training-side features, each within [0, 1]."""
    get = lambda name: number(rec.get(name, F.lit(None)))
    size = clip(get("bytes"), 0, 1e9)
    src, dst = clip(get("src_port"), 0, 65535), clip(get("dst_port"), 0, 65535)
    duration = clip(get("flow_duration"), 0, 1e9)
    fwd, bwd = clip(get("fwd_packets"), 0, 1e6), clip(get("bwd_packets"), 0, 1e6)
    proto = get("protocol").cast("bigint")
    seconds = F.greatest(duration / F.lit(1e6), F.lit(1e-3))
    packets = fwd + bwd + F.lit(1e-6)
    if "timestamp" in rec:
        hour = F.hour(rec["timestamp"])
        when = {
            "hour": F.coalesce(hour, F.lit(12)) / F.lit(23.0),
            "weekday": F.coalesce(F.weekday(rec["timestamp"]), F.lit(0)) / F.lit(6.0),
            "off_hours": flag((hour < 8) | (hour >= 18)),
            "night": flag((hour < 6) | (hour >= 22)),
        }
    else:
        when = {"hour": F.lit(0.5), "weekday": F.lit(0.5), "off_hours": F.lit(0.0), "night": F.lit(0.0)}
    spread = F.greatest(F.abs(dst - src), F.lit(1.0))
    return {
        "bytes": clip(size / F.lit(1e6), 0, 1),
        "src_port": src / F.lit(65535.0),
        "dst_port": dst / F.lit(65535.0),
        "flow_duration": clip(duration / F.lit(1e8), 0, 1),
        "fwd_packets": clip(fwd / F.lit(1e4), 0, 1),
        "bwd_packets": clip(bwd / F.lit(1e4), 0, 1),
        "protocol_tcp": flag(proto == 6),
        "protocol_udp": flag(proto == 17),
        "protocol_icmp": flag(proto == 1),
        "status_code": F.lit(0.0),
        "hour_of_day": when["hour"],
        "day_of_week": when["weekday"],
        "is_off_hours": when["off_hours"],
        "is_night": when["night"],
        "port_entropy": F.log1p(spread) / F.log1p(F.lit(65535.0)),
        "byte_rate": clip(size / seconds / F.lit(1e9), 0, 1),
        "packet_ratio": fwd / packets,
        "is_privileged_port": flag(dst < 1024),
        "is_high_port": flag(dst >= 49152),
        "connection_density": clip(packets / seconds / F.lit(1e6), 0, 1),
    }


def forest_extras(rec: dict[str, Column], port_entropy: Column, destinations: Column) -> dict[str, Column]:
    """Five more features for the forest; the last two come from A-08 per source."""
    get = lambda name: number(rec.get(name, F.lit(None)))
    packets = F.greatest(get("fwd_packets") + get("bwd_packets"), F.lit(1.0))
    return {
        "syn_ack_ratio": clip(get("syn_flag") / F.greatest(get("ack_flag") + 1, F.lit(1.0)), 0, 20) / F.lit(20.0),
        "packet_length_variance": clip(get("pkt_len_var") / F.lit(1e6), 0, 1),
        "rst_rate": clip(get("rst_flag") / packets, 0, 1),
        "source_port_entropy": clip(port_entropy / F.lit(16.0), 0, 1),
        "source_destinations": clip(destinations / F.lit(1000.0), 0, 1),
    }


def text_entropy(text: Column) -> Column:
    """Shannon entropy in bits of the lower-cased characters."""

    def bits(chars: Column) -> Column:
        shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda o: o == c)) / F.size(chars))
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return bound(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), bits)


def signals(rec: dict[str, Column], width: int = 16) -> dict[str, Column]:
    """Name lookup, sign-in, process and network signals, ``width`` values each."""
    get = lambda name: number(rec.get(name, F.lit(None)))
    text = lambda *names: F.coalesce(*[rec[n] for n in names if n in rec], F.lit(""))
    domain, user, process = text("domain", "path"), F.lower(text("user")), text("process", "method")
    low = F.lower(process)
    dst, src, logon, status = get("dst_port"), get("src_port"), get("logon_type"), get("status")
    length = F.length(domain).cast("double")
    suspicious = F.lit(False)
    for word in params.SUSPICIOUS_PROCESSES:
        suspicious = suspicious | low.contains(word)
    parts = {
        "dns": [length / F.lit(100.0), text_entropy(domain) / F.lit(5.0), flag(dst == 53), flag(length > 50)],
        "auth": [
            flag(status.isin(401, 403) | (logon == 3)),
            flag(user.contains("admin")),
            F.when(logon > 0, logon / F.lit(10.0)).otherwise(F.lit(0.0)),
            flag(dst == 389),
            flag(dst == 88),
        ],
        "process": [
            F.length(process) / F.lit(50.0),
            flag(suspicious),
            flag(low.contains("shell")),
            flag(low.contains("script")),
        ],
        "network": [
            F.least(get("bytes") / F.lit(100000.0), F.lit(1.0)),
            flag((dst < 1024) & (dst > 0)),
            flag(src > 49152),
            F.least(get("fwd_packets") / F.lit(100.0), F.lit(1.0)),
            F.least(get("bwd_packets") / F.lit(100.0), F.lit(1.0)),
            F.least(get("flow_duration") / F.lit(1e6), F.lit(1.0)),
            flag(dst.isin(*params.UNUSUAL_PORTS)),
            flag(dst == 3389),
        ],
    }
    return {name: F.array(*values, *[F.lit(0.0)] * (width - len(values))) for name, values in parts.items()}
