"""Parameters and fixed values.

Everything in the "fixed values" sections must equal the published behaviour
for results to match, so it is written out plainly.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Source trust, in table order (the first row wins on a partial
# match).
# ---------------------------------------------------------------------------
TRUST_TABLE = [
    ("certin", 0.95),
    ("mitre", 0.90),
    ("nvd", 0.85),
    ("crowdstrike", 0.75),
    ("mandiant", 0.75),
    ("paloalto", 0.75),
    ("sentinelone", 0.75),
    ("microsoft", 0.75),
    ("vendor", 0.75),
    ("internal", 0.70),
    ("partner", 0.50),
    ("uimanual", 0.85),
    ("uitemplate", 0.85),
    ("uiupload", 0.85),
    ("manual", 0.85),
    ("template", 0.85),
    ("upload", 0.85),
    ("demo", 0.80),
    ("test", 0.80),
    ("simulation", 0.80),
]
TRUST_UNKNOWN = 0.0
SOURCE_KEYS = ["source", "Source", "src", "feed", "origin", "SOURCE"]
ASSET_KEYS = ["asset_id", "host", "hostname", "device", "src_ip", "ip"]
TIME_KEYS = ["timestamp", " Timestamp", "TimeCreated", "start"]

# ---------------------------------------------------------------------------
# Sanitiser rules (name, Java pattern, replacement), in order.
# The flags keep the character classes Unicode-aware and "\n" the only line end.
# ---------------------------------------------------------------------------
SANITIZE_RULES = [
    ("JNDI_INJECTION", r"(?iu)\$\{jndi:[^}]*\}", "[SANITIZED:JNDI]"),
    ("SCRIPT_TAG", r"(?isu)<script[^>]*>.*?</script>", "[SANITIZED:XSS]"),
    ("HTML_EVENT", r"""(?iU)\bon\w+\s*=\s*["'][^"']*["']""", "[SANITIZED:HTML_EVENT]"),
    (
        "SQL_INJECTION",
        r"""(?imdU)('|"|`)\s*(OR|AND)\s+\1?\d+\1?\s*=\s*\1?\d+|--\s*$|;\s*DROP\s+TABLE|UNION\s+(ALL\s+)?SELECT""",
        "[SANITIZED:SQLi]",
    ),
    ("PATH_TRAVERSAL", r"(?iu)\.\./|\.\.\\|%2e%2e[/\\]", "[SANITIZED:PATH_TRAVERSAL]"),
    ("HIDDEN_UNICODE", r"[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u00ad]", ""),
    ("TEMPLATE_INJECTION", r"(?s)\{\{.*?\}\}|\{%.*?%\}", "[SANITIZED:TEMPLATE]"),
]

# What a text holds that any of the rules matches, as a pattern that is cheap to look for.
SANITIZE_NEEDS = r"""(?s)\$\{|[<='"`;]|--|[uU][nN].[oO][nN]|\.\.|%2|\{[{%]|[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u00ad]"""

# Output-screen patterns (secrets and personal data).
OUTPUT_PATTERNS = [
    ("aws_key", r"AKIA[0-9A-Z]{16}"),
    ("credential_password", r"(?iU)password\s*[:=]\s*\S+"),
    ("pii_email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("pii_phone_in", r"(?U)(?<!\d)(\+91|0)?[6-9]\d{9}(?!\d)"),
    ("secret_token", r"(?iU)(api_key|token|secret|bearer)\s*[:=]\s*[A-Za-z0-9_\-\.]{20,}"),
]
FINDING_CHARS = 60

# Prompt-injection screen.
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"you\s+are\s+now\s+a",
    r"(forget|disregard)\s+(everything|all)",
    r"(act|behave)\s+as\s+(if\s+)?you\s+(are|were)",
    r"(print|reveal|output|show)\s+(your\s+)?(system\s+)?prompt",
    r"jailbreak",
    r"\$\{jndi:",
]
EXCERPT_CHARS = 500

# Control-protocol signatures; v1 scans keys and values, v2 values only.
OT_SIGNATURES_V1 = [
    ("Modbus", ["modbus", "mbap", "function_code", "function code"]),
    ("DNP3", ["dnp3", "dnp ", "dlp ", "distributed network protocol"]),
    ("S7", ["s7comm", "s7 ", "iso 8073", "siemens s7"]),
    ("OPC-UA", ["opc-ua", "opcua", "opc_ua", "ua binary", "4840"]),
    ("IEC-61850", ["iec-61850", "iec61850", "goose", "sampled values", "mms "]),
]
OT_SIGNATURES_V2 = [
    ("Modbus", ["modbus", "502", "function_code"]),
    ("DNP3", ["dnp3", "dnp", "20000"]),
    ("S7", ["s7comm", "s7", "102"]),
    ("OPC-UA", ["opcua", "opc-ua", "opc_ua", "4840"]),
    ("IEC-61850", ["iec61850", "61850", "goose", "mms"]),
]

# Raw field -> canonical field, by source type.
FIELD_MAPS = {
    "web_access_log": {
        "src_ip": "src_ip", "dst_ip": "dst_ip", "request_path": "path", "http_method": "method",
        "user_agent": "user_agent", "status_code": "status", "bytes_sent": "bytes",
        "protocol": "protocol", "timestamp": "timestamp",
    },
    "cicids_2017": {
        " Source IP": "src_ip", " Destination IP": "dst_ip", " Source Port": "src_port",
        " Destination Port": "dst_port", " Protocol": "protocol", " Flow Duration": "flow_duration",
        " Total Fwd Packets": "fwd_packets", " Total Backward Packets": "bwd_packets",
        " Total Length of Fwd Packets": "bytes", " Label": "label", "Flow ID": "flow_id",
        " Timestamp": "timestamp",
    },
    "windows_event": {
        "EventID": "event_id", "SubjectUserName": "user", "TargetUserName": "target_user",
        "IpAddress": "src_ip", "ProcessName": "process", "LogonType": "logon_type",
        "Status": "status", "TimeCreated": "timestamp",
    },
    "netflow": {
        "src_addr": "src_ip", "dst_addr": "dst_ip", "src_port": "src_port", "dst_port": "dst_port",
        "proto": "protocol", "bytes": "bytes", "pkts": "packets", "start": "timestamp",
    },
    "scada": {
        "src_ip": "src_ip", "dst_ip": "dst_ip", "function": "method", "register": "path",
        "value": "value", "protocol": "protocol", "timestamp": "timestamp",
    },
}
CANONICAL_FIELDS = [
    "src_ip", "dst_ip", "src_port", "dst_port", "path", "method",
    "user_agent", "status", "bytes", "protocol", "timestamp",
]
# (any of / all of, keys, type) in detection order.
SOURCE_TYPE_KEYS = [
    ("any", [" Source IP", "Flow ID"], "cicids_2017"),
    ("any", ["EventID", "SubjectUserName"], "windows_event"),
    ("any", ["src_addr", "dst_addr"], "netflow"),
    ("all", ["function", "register"], "scada"),
    ("any", ["http_method", "request_path"], "web_access_log"),
]

# What an asset missing from the inventory is taken to be.
UNKNOWN_ASSET = {
    "criticality": "MEDIUM", "mission": "unknown", "type": "unknown", "safety_critical": False,
    "can_reboot": True, "can_interrupt": True, "impact_if_compromised": "MEDIUM",
}

# Entity patterns of the normaliser, group 1 is the entity.
NER_PATTERNS = [
    ("ip", r"(?U)\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"),
    ("user", r"""(?iU)user[=:\s]+([^\s,;"']+)"""),
    ("process", r"""(?iU)process[=:\s]+([^\s,;"']+)"""),
    ("domain", r"""(?iU)(?:domain|hostname)[=:\s]+([^\s,;"']+)"""),
    ("hash", r"(?U)\b([a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})\b"),
]

# Indicator patterns (type, pattern, priority), group 1 is the value.
IP_PATTERN = r"(?U)\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
HASH_PATTERN = r"(?U)\b([a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b"
DOMAIN_PATTERN = r"(?U)\b([a-zA-Z0-9-]{2,63}\.[a-zA-Z]{2,6})\b"
URL_PATTERN = r"""(?U)(https?://[^\s"'<>]+)"""
IOC_PATTERNS = [
    ("hash", HASH_PATTERN, 1),
    ("ip", IP_PATTERN, 2),
    ("domain", DOMAIN_PATTERN, 3),
    ("url", URL_PATTERN, 4),
]
PRIVATE_IP_HUNT = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|0\.0\.0\.0)"
PRIVATE_IP_SHARE = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|169\.254\.|0\.0\.0\.0)"
PII_FIELDS = [
    "src_ip", "user", "asset_id", "internal_domain", "hostname", "email",
    "username", "user_id", "internal_ip",
]

# Rule tables keyed by mission substring, in order, with a default.
CRITIC_RULES = [
    ("exam_portal", 0.08, "proceed"),
    ("power_management", 0.22, "proceed"),
    ("patient_records", 0.35, "human_review"),
]
CRITIC_DEFAULT = (0.12, "proceed")
ATTRIBUTION_RULES = [
    ("exam_portal", "T1595,T1190,T1059,T1003", 0.85, "APT41"),
    ("power_management", "T1566,T1078,T1021,T1486,T1489", 0.80, "RansomwareGroup"),
]
ATTRIBUTION_DEFAULT = ("T1595,T1190,T1059", 0.65, "Unknown")

# Scores.
CRITICALITY = {"CRITICAL": 1.00, "HIGH": 0.75, "MEDIUM": 0.50, "LOW": 0.25}
EXPOSURE = {True: 1.0, False: 0.4}
IMPACT_MULTIPLIER = {"CRITICAL": 0.8, "HIGH": 0.9, "MEDIUM": 1.0, "LOW": 1.1}
COUNTER_EVIDENCE = [
    ("whitelisted", 0.80), ("scanner", 0.85), ("valid_cert", 0.90),
    ("redteam_window", 0.80), ("patch_window", 0.85),
]
ROLE_WEIGHTS = {"SENIOR": 0.9, "JUNIOR": 0.3, "EXTERNAL": 0.8, "UNKNOWN": 0.5}
CONSENSUS_THRESHOLD = 0.7
PROMOTION_RATIO = 0.95
LIFE_SAFETY_INDUSTRIES = ["healthcare", "power_grid", "railway", "nuclear"]
SEVERITY_RANK = {"INFO": 0, "WARN": 1, "HIGH": 2, "CRITICAL": 3}
HASH_EMBED_DIM = 384
GENOME_DIM = 64
GENOME_THRESHOLD = 0.70
FUZZY_THRESHOLD = 0.85
FUZZY_CONFIDENCE = 0.95
INDICATOR_TTL_DAYS = 7
REPUTATION_TTL_HOURS = 24
DECISION_TTL_DAYS = 30
SHARE_THRESHOLD = 0.85
HUNT_THRESHOLD = 0.7
REPORT_DEADLINE_SECONDS = 21600

# Flow-label words, incident categories, calendar.
BENIGN_WORDS = ["benign", "normal", "0"]
HOLIDAYS = [(1, 26), (8, 15), (10, 2), (12, 25)]
ELECTION_WINDOWS = [("2024-04-19 00:00:00", "2024-06-04 00:00:00")]
TECHNIQUE_CATEGORIES = [
    (["T1566"], "Phishing"),
    (["T1486"], "Ransomware"),
    (["T1499"], "DDoS"),
    (["T1003", "T1078", "T1021"], "Unauthorized Access"),
    (["T1190"], "Vulnerability Exploitation"),
    (["T1204", "T1059"], "Malicious Code"),
    (["T1595"], "Network Scanning"),
]
STIX_LABELS = {
    "attack-pattern": ("Technique", True),
    "x-mitre-tactic": ("Tactic", True),
    "intrusion-set": ("ThreatGroup", True),
    "course-of-action": ("Mitigation", False),
    "malware": ("Software", False),
    "tool": ("Software", False),
    "campaign": ("Campaign", False),
}
NODE_KIND = {
    "Computer": "server", "IP": "cloud", "User": "service", "Asset": "server", "OTSensor": "db",
    "Technique": "firewall", "Tactic": "firewall", "ThreatGroup": "crown", "Mitigation": "service",
    "Software": "cloud", "Campaign": "crown", "Entity": "server",
}
NODE_SEVERITY = {
    "ThreatGroup": "critical", "Campaign": "critical", "Technique": "suspicious",
    "Tactic": "suspicious", "OTSensor": "warning",
}
NODE_TYPE_INDEX = {
    "computer": 0, "ip": 1, "user": 2, "technique": 3,
    "tactic": 4, "threatgroup": 5, "otsensor": 6, "asset": 7,
}
CORPUS_TRUST = {"MITRE": 0.90, "NVD": 0.85, "CERT-In": 0.95}
SUSPICIOUS_PROCESSES = [
    "powershell", "cmd", "wscript", "cscript", "mshta", "certutil", "bitsadmin", "rundll32",
]
UNUSUAL_PORTS = [4444, 5555, 6666, 1389, 8443]


@dataclass(frozen=True)
class DecisionThresholds:
    """Limits of the response rule. ``safety_gate`` off skips the safety check."""

    act_above: float = 0.50
    blast_limit: float = 0.30
    safety_gate: bool = True


STANDARD = DecisionThresholds()
DEMONSTRATION = DecisionThresholds(act_above=0.20, safety_gate=False)
