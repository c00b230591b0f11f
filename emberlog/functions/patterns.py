"""Fixed values of the log engine: patterns, word lists and key lists, stated as Java regular expressions.

Word boundaries are written as look-arounds on ASCII word characters, so that letters beyond ASCII don't
move them; ``(?d)`` makes a dot stop at newlines only.
"""

EDGE_BEFORE, EDGE_AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"

# Line formats.
KUBERNETES = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\s+(stdout|stderr)\s+[FP]\s+"
KUBE_PREFIXED = r"^\[[\w/.:-]+\]\s+\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
SYSLOG_5424 = r"^<\d+>\d+\s+"
SYSLOG_3164 = r"^<\d+>(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s"
CLF = r"^\S+\s+\S+\s+\S+\s+\[\d{2}/[A-Z]"
LOGFMT_PAIR = EDGE_BEFORE + r'\w+=(?:"[^"]*"|\S+)'
COMPOSE = r"^\w[\w.-]*-\d+\s+\|\s+"
GENERIC = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
CSV_DATA = r"(?i)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^,]*,\s*(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|ERR)\s*,"
SYSLOG_3164_FULL = r"(?d)^<(\d+)>(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)\z"
SYSLOG_5424_FULL = r"(?d)^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)\z"
SYSLOG_5424_DATA = r"(?d)^(?:-|\[.*?\](?:\[.*?\])*)\s*"
CLF_FULL = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*?)"\s+(\d{3})\s+(\d+|-)'
CSV_HEADERS = ["timestamp", "@timestamp", "time", "ts", "date", "datetime", "level", "severity", "lvl", "loglevel", "message", "msg", "log", "source", "service", "host", "hostname"]

# Variable parts of messages, the first that is found inside a match names it.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
TIME = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
IPV6 = r"[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}"
HEX = EDGE_BEFORE + r"[0-9a-fA-F]{8,}" + EDGE_AFTER
PATH = r"/[\w./\-]+"
QUOTED = r'"[^"]*"'
NUMBER = EDGE_BEFORE + r"\d+"
VARIABLE = [("<UUID>", UUID), ("<TS>", TIME), ("<IP>", IPV4), ("<IP>", IPV6), ("<HEX>", HEX), ("<PATH>", PATH), ("<STR>", QUOTED), ("<NUM>", NUMBER)]

# Messages that are noise wherever they stand, compared in lower case.
NOISE = [
    "GET /healthz", "GET /health", "GET /ready", "GET /readyz", "GET /livez", "GET /live", "GET /ping", "GET /status", "health check passed",
    "/metrics", "prometheus scrape",
    "leader election", "lease renewed", "Successfully synced", "BackOff restarting",
    "TLS handshake complete", "certificate verified",
    "connection pool stats", "pool size", "idle connections",
    "retrying request", "request retry", "SDK retry",
]

# Fields in messages and the metadata keys that come before them.
HTTP_STATUS = r"(?:HTTP[/ ][\d.]+\s+|status[= :]?\s*)(\d{3})" + EDGE_AFTER
ERROR_TYPE = r"(?:(?:Caused by|Exception|Error|Panic|FATAL):\s*)([\w.]+)"
TRACE_ID = r"""(?i)(?:trace[_-]?id|request[_-]?id|correlation[_-]?id)[=: ]+["']?([a-zA-Z0-9\-]{8,})"""
STATUS_KEYS = ["status", "status_code", "http_status", "statusCode", "response_code"]
ERROR_KEYS = ["error", "error.type", "exception", "exception.type", "err"]
TRACE_KEYS = ["trace_id", "traceId", "trace", "request_id", "requestId", "x-request-id", "correlation_id"]

# Deployment events.
DEPLOY = [
    r"starting\s+(application|service|server)", r"listening\s+on\s+port", r"(deployed|deploying|deployment)\s+(version|v\d)", r"rolling\s+update", r"container\s+started",
    r"migration\s+(applied|running|complete)", r"version\s*[:=]\s*v?\d+\.\d+", r"(restarted|restart\s+complete)", r"pulling\s+image", r"(scaling|scaled)\s+(up|down|to)",
]
DEPLOY_KEYS = ["event", "action", "type"]
DEPLOY_VALUES = ["deploy", "restart", "rollout", "scale"]

# Error chains as (name, window in seconds, three stages of pattern and least level).
WARN, ERROR, INFO = 4, 5, 3
CHAINS = [
    ("db-connection-exhaustion", 300, [
        (r"(deadlock|lock\s+timeout|lock\s+wait)", WARN),
        (r"(connection\s+pool\s+exhausted|no\s+available\s+connections|too\s+many\s+connections)", ERROR),
        (r"(query\s+failed|cannot\s+execute|database\s+error|sql\s+error)", ERROR)]),
    ("oom-cascade", 180, [
        (r"(memory\s+(warning|threshold|pressure|limit)|heap\s+(usage|size)\s*(>|exceed))", WARN),
        (r"(OOM\s*kill|out\s+of\s+memory|memory\s+limit\s+exceeded|killed\s+process)", ERROR),
        (r"(pod\s+restart|service\s+unavailable|container\s+(restart|crash)|exit\s+code\s+137)", ERROR)]),
    ("deployment-failure", 600, [
        (r"(deploy(ing|ment)\s+start|rolling\s+update|new\s+version|pulling\s+image)", INFO),
        (r"(health\s*check\s+(fail|timeout|unhealthy)|readiness\s+probe\s+failed|liveness\s+probe\s+failed)", WARN),
        (r"(rollback|roll\s+back|reverting|deployment\s+failed|undo)", ERROR)]),
    ("circuit-breaker", 120, [
        (r"(timeout|connection\s+refused|connect\s+failed|ECONNREFUSED)", ERROR),
        (r"(circuit\s+(open|breaker\s+open|breaker\s+tripped))", WARN),
        (r"(fallback\s+(activated|triggered|used)|degraded\s+mode)", WARN)]),
    ("disk-full", 300, [
        (r"(disk\s+space\s+(warning|low|critical)|filesystem\s+(full|usage).*\d{2,3}%)", WARN),
        (r"(write\s+fail|no\s+space\s+left|ENOSPC|cannot\s+write|disk\s+full)", ERROR),
        (r"(crash|exit|abort|fatal|service\s+(stopped|terminated))", ERROR)]),
    ("certificate-expiry", 300, [
        (r"(certificate?\s+(expir|near\s+expiry|will\s+expire)|TLS\s+warning|cert\s+renewal)", WARN),
        (r"(TLS\s+handshake\s+(fail|error)|SSL\s+error|certificate?\s+(invalid|expired|verify\s+fail))", ERROR),
        (r"(connection\s+refused|connection\s+closed|cannot\s+connect|ECONNREFUSED)", ERROR)]),
    ("dns-failure", 180, [
        (r"(DNS\s+(timeout|resolution\s+fail|lookup\s+fail|NXDOMAIN)|name\s+resolution\s+fail)", ERROR),
        (r"(connection\s+failed|cannot\s+connect|dial\s+(tcp|error)|ECONNREFUSED)", ERROR),
        (r"(upstream\s+(unavailable|error|timeout)|service\s+unavailable|bad\s+gateway|502|503)", ERROR)]),
    ("rate-limiting", 300, [
        (r"(rate\s+limit\s+(warning|approaching|threshold)|throttl(e|ing))", WARN),
        (r"(429|too\s+many\s+requests|rate\s+limit\s+(exceeded|hit))", ERROR),
        (r"(client\s+error|request\s+failed|service\s+degraded|dropped\s+request)", ERROR)]),
    ("queue-backlog", 600, [
        (r"(consumer\s+lag|processing\s+behind|queue\s+(depth|size)\s*(>|exceed|growing))", WARN),
        (r"(queue\s+full|buffer\s+(full|overflow)|message\s+(dropped|rejected))", ERROR),
        (r"(producer\s+blocked|publish\s+failed|backpressure|send\s+timeout)", ERROR)]),
    ("cascade-failure", 300, [
        (r"(failed|error|exception).*service", ERROR),
        (r"(timeout|timed?\s+out).*upstream", ERROR),
        (r"(HTTP\s+5\d{2}|status[=: ]+5\d{2}|5\d{2}\s+(error|response))", ERROR)]),
]
