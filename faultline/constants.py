"""Fixed values. Results depend on every literal in this file; none of them is derived."""

# --- fixed values: log schema ------------------------------------------------------------
REQUIRED_COLUMNS = [
    "LineId", "Date", "Time", "Pid", "Level",
    "Component", "Content", "EventId", "EventTemplate",
]
VALID_LEVELS = ["INFO", "WARN", "WARNING", "ERROR", "FATAL", "DEBUG"]
ERROR_LEVELS = ["ERROR", "FATAL"]
SEVERE_LEVELS = ["WARN", "ERROR", "FATAL"]
SEVERITY_RANK = {"FATAL": 0, "ERROR": 1, "WARN": 2, "UNKNOWN": 3, "DEBUG": 4, "INFO": 5}
OTHER_SEVERITY_RANK = 3

# --- fixed values: content signals (name, pattern on lower-cased text, row flag, feature) --
SIGNALS = [
    ("heartbeat", "heartbeat", "heartbeat_failure", "heartbeat_failures"),
    ("block", "block|blk_", "block_error", "block_errors"),
    ("replication", "replicat", "replication_error", "replication_errors"),
    ("network", "network|connection|socket|timeout|timed out", "network_error", "network_errors"),
    ("disk", "disk|storage|volume", "disk_error", "disk_errors"),
]
SIGNAL_NAMES = [s[0] for s in SIGNALS]

# --- fixed values: window feature names, in model order ----------------------------------
FEATURES = [
    "logs_per_window",
    "error_count", "warning_count", "info_count", "fatal_count",
    "heartbeat_failures", "block_errors", "replication_errors",
    "network_errors", "disk_errors",
    "unique_components", "unique_event_ids", "unique_processes",
    "error_ratio", "warning_ratio", "fatal_ratio",
]

# --- fixed values: limits ----------------------------------------------------------------
MAX_COMPONENTS = 10
MAX_LOG_LINES = 30
MAX_LOG_CHARS = 300
MAX_RUNBOOK_CHARS = 600
MAX_SIGNAL_SEARCHES = 2
SIMILAR_TOP_K = 3
HISTORY_LIMIT = 20

# --- fixed values: text masking, applied in this order -----------------------------------
MASKS = [
    (r"blk_-?\d+", "blk_<id>"),
    (r"\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?", "<ip>"),
    (r"\d{4,}", "<n>"),
]

# --- fixed values: detector --------------------------------------------------------------
N_TREES = 200
CONTAMINATION = 0.05
SEED = 42
SUBSAMPLE = 256
MIN_TRAIN_ROWS = 5
MIN_SCALE = 1e-6
EULER_GAMMA = 0.5772156649
STRONG_SHARE = 0.6
MEDIUM_SHARE = 0.3

# --- fixed values: factor text -----------------------------------------------------------
NO_FACTORS_TEXT = "No contributing factors were found."
NO_RISING_TEXT = "No factor pushed this window toward being flagged as abnormal."
RISING_HEADER = "Main factors pushing this window toward 'abnormal':\n"

# --- fixed values: retrieval -------------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
CANDIDATES = 10
DENSE_WEIGHT = 0.7
SPARSE_WEIGHT = 0.3
RRF_CONSTANT = 60
MAX_DISTANCE = 0.9
MIN_BM25 = 2.0
RETRIEVE_TOP_K = 3
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
MIN_CHUNK_CHARS = 20
CONTEXT_CHARS = 6000
HASH_DIMS = 64

# --- fixed values: cause catalogue, in tie-break order -----------------------------------
# (cause, runbook key, trouble pattern, name pattern, feature, recommendations)
CAUSES = [
    (
        "DataNode failure", "datanode",
        r"heartbeat|dead ?node|lost (contact|heartbeat)|"
        r"datanode.*(down|fail|exception|unavailable|not responding)|"
        r"got exception while serving|writeblock.*exception|receiveblock.*exception",
        r"data ?node",
        "heartbeat_failures",
        [
            "Check that the affected DataNodes are running and registered (hdfs dfsadmin -report).",
            "Review DataNode logs around this window for exceptions and heartbeat timeouts.",
            "Verify network connectivity between the DataNodes and the NameNode.",
            "Confirm affected blocks are still replicated (hdfs fsck / -blocks -locations).",
        ],
    ),
    (
        "NameNode failure", "namenode",
        r"namenode.*(down|fail|exception|unavailable|not responding|error)|safe ?mode|"
        r"edit ?log|fsimage|checkpoint|standby|failed to (load|save) (fsimage|edits)",
        r"name ?node",
        None,
        [
            "Check NameNode status and whether it is stuck in safe mode (hdfs dfsadmin -safemode get).",
            "Inspect NameNode logs, edit log and fsimage health; check heap and GC pressure.",
            "Verify the standby NameNode / failover controller if HA is configured.",
        ],
    ),
    (
        "Disk failure", "disk",
        r"disk|no space left|out of space|read-only file ?system|i/o error|"
        r"volume.*(fail|error)|bad (disk|sector)|checksum|corrupt",
        r"\bdisk\b|storage|volume",
        "disk_errors",
        [
            "Check free space and disk health on the affected DataNodes (df -h, SMART).",
            "Look for failed volumes and review dfs.datanode.du.reserved.",
            "Run hdfs fsck to find corrupt blocks and let HDFS re-replicate them.",
        ],
    ),
    (
        "Network failure", "network",
        r"timeout|timed out|connection (reset|refused|closed|timed)|broken pipe|socket|"
        r"unreachable|no route|network|eofexception|could not read from stream",
        r"network|connectivity",
        "network_errors",
        [
            "Test connectivity and latency between the affected nodes (ping, traceroute).",
            "Check firewalls, required ports and switch/NIC error counters.",
            "Review socket timeout settings (e.g. dfs.client.socket-timeout).",
        ],
    ),
    (
        "Replication failure", "replication",
        r"under[- ]?replicat|replicat.*(fail|error|pending|timeout)|missing block|"
        r"could only be replicated|not enough replicas|corrupt replica|no live (datanodes|replica)",
        r"replicat",
        "replication_errors",
        [
            "List under-replicated / missing blocks (hdfs fsck / -files -blocks).",
            "Make sure enough live DataNodes exist to satisfy the replication factor.",
            "Trigger re-replication if needed (hdfs dfs -setrep) and watch the pending queue.",
        ],
    ),
]
NO_INCIDENT = "No abnormal behaviour detected"
UNDETERMINED = "Anomalous behaviour, cause undetermined"
GENERAL_RECOMMENDATIONS = {
    NO_INCIDENT: ["No action needed; keep monitoring and compare with later windows."],
    UNDETERMINED: [
        "Read the raw logs of this window and look for the first abnormal line.",
        "Compare with the similar incidents listed in this report.",
        "Search the runbooks manually with the exact error text.",
    ],
}

# --- fixed values: evidence weights ------------------------------------------------------
LEVEL_WEIGHT = {"FATAL": 3.0, "ERROR": 3.0, "WARN": 2.0}
OTHER_LEVEL_WEIGHT = 0.5
QUERY_PATTERN_WEIGHT = 2.0
QUERY_NAME_WEIGHT = 1.0
FEATURE_CAP = 5.0
RUNBOOK_WEIGHT = {1: 1.5, 2: 1.0, 3: 0.5}
OTHER_RUNBOOK_WEIGHT = 0.25
MIN_DIRECT = 1.5
SUPPORT_FULL = 8.0
MIN_SIMILARITY = 0.3
MIN_ERROR_RATIO = 0.1
INCIDENT_ID_IN_TEXT = r"(?i)\bINC[-_ ]?\d+\b"
INCIDENT_ID_PATTERN = r"(?i)^\s*(?:INC[-_ ]?)?0*(\d+)\s*$"

# --- fixed values: search texts ----------------------------------------------------------
SIGNAL_QUERIES = {
    "heartbeat": "HDFS DataNode heartbeat failure",
    "replication": "HDFS block replication failure under-replicated blocks",
    "network": "HDFS network connection timeout failure",
    "disk": "HDFS disk failure no space left on device",
}
QUERY_HINTS = [
    ("heartbeat_failures", "heartbeat failure DataNode"),
    ("network_errors", "network connection timeout"),
    ("disk_errors", "disk failure"),
    ("replication_errors", "replication failure"),
    ("block_errors", "block error"),
]
QUERY_HEAD = "HDFS"
QUERY_FALLBACK = "HDFS abnormal behaviour troubleshooting"
QUERY_LINE_CHARS = 120
NOTE_LINE_CHARS = 80
MAX_LOG_NOTES = 4

# --- fixed values: evidence and plan sentences -------------------------------------------
FEATURE_LABELS = [
    ("heartbeat_failures", "ERROR/FATAL line(s) about heartbeats"),
    ("block_errors", "ERROR/FATAL line(s) about blocks"),
    ("replication_errors", "ERROR/FATAL line(s) about replication"),
    ("network_errors", "ERROR/FATAL line(s) about network problems"),
    ("disk_errors", "ERROR/FATAL line(s) about disk/storage"),
]
PLAN_HEAD = [
    ("get_logs", "Read the log lines, most severe first"),
    ("get_features", "Get the numeric features of the window"),
    ("detect_anomaly", "Check whether the ML model finds it abnormal"),
]
PLAN_AUTO = ("search_runbook", "Search runbooks using the strongest evidence found so far")
PLAN_TAIL = ("find_similar_incidents", "Find windows with a similar profile")
PLAN_TEXT = [("search_runbook", "Search the runbooks")]
REASON_NORMAL = "ML score is below the threshold and there are no WARN/ERROR/FATAL signals."
REASON_NO_DIRECT = ("No failure category has enough direct evidence "
                    "(runbook matches alone are not enough).")
DISCLAIMER = "Confidence is a heuristic evidence score, not a calibrated probability."
LIMIT_NO_MODEL = "ML anomaly detection was unavailable; confidence is lower."
LIMIT_NO_RUNBOOK = "No runbook passed the relevance filter for this incident."

# --- fixed values: evaluation ------------------------------------------------------------
INCIDENT_FEATURES = [
    "error_count", "fatal_count", "warning_count", "heartbeat_failures",
    "block_errors", "replication_errors", "network_errors", "disk_errors",
]
SYNTHETIC_CAVEAT = (
    "Synthetic anomalies were injected into real feature rows; these figures show whether clear "
    "anomalies are separated from the real windows, not accuracy on actual failures."
)
EVAL_CASES = [
    ("DataNode is not sending heartbeats to the NameNode", "hdfs_datanode_failure.md"),
    ("lost contact with a DataNode, is it dead", "hdfs_datanode_failure.md"),
    ("DataNode process crashed with an out of memory error", "hdfs_datanode_failure.md"),
    ("NameNode stuck in safe mode after restart", "hdfs_namenode_failure.md"),
    ("fsimage or edit log failed to load on startup", "hdfs_namenode_failure.md"),
    ("standby NameNode failover is not happening", "hdfs_namenode_failure.md"),
    ("no space left on device on a DataNode volume", "hdfs_disk_failure.md"),
    ("disk volume became read-only filesystem", "hdfs_disk_failure.md"),
    ("checksum mismatch or corrupt block on disk", "hdfs_disk_failure.md"),
    ("connection timed out between HDFS nodes", "hdfs_network_failure.md"),
    ("socket exception broken pipe while writing a block", "hdfs_network_failure.md"),
    ("clients cannot reach the NameNode, network unreachable", "hdfs_network_failure.md"),
    ("blocks are under-replicated across the cluster", "hdfs_replication_failure.md"),
    ("could only be replicated to 0 nodes instead of minReplication",
     "hdfs_replication_failure.md"),
    ("fsck reports missing blocks", "hdfs_replication_failure.md"),
]
