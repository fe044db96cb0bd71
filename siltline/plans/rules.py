"""The rule catalogue: what each rule looks for, where, and how sure it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    """``group`` is the capture group that holds a secret's value (0: the whole match); ``languages`` empty means any;
    a secret's match holds one of its ``hints``, or without any a colon or an equals sign; that is cheaper to test."""

    rule_id: str
    scanner: str
    category: str
    severity: str
    confidence: int
    title: str
    pattern: str = ""
    languages: tuple[str, ...] = ()
    classification: str | None = None
    cwe: tuple[str, ...] = ()
    group: int = 1
    min_entropy: float | None = None
    excluded: str | None = None
    hints: tuple[str, ...] = ()


# Shapes of secrets.
_S = ("secrets", "Secrets")
SECRETS = (
    Rule("SECRET-001", *_S, "HIGH", 95, "cloud access key id", r"\b(AKIA[0-9A-Z]{16})\b", cwe=("CWE-798",), hints=("AKIA",)),
    Rule("SECRET-002", *_S, "CRITICAL", 90, "cloud secret key assigned", r"(?i)(?:aws_secret_access_key|aws_sec_key|secret_access_key)\s*[:=]\s*['\"]?([0-9a-zA-Z/+=]{40})['\"]?", cwe=("CWE-798",), min_entropy=4.2),
    Rule("SECRET-003", *_S, "CRITICAL", 98, "personal access token of a code forge", r"\b(ghp_[A-Za-z0-9_]{36,255}|github_pat_[A-Za-z0-9_]{22}_[A-Za-z0-9_]{59})\b", cwe=("CWE-798",), hints=("ghp_", "github_pat_")),
    Rule("SECRET-004", *_S, "HIGH", 95, "app or user token of a code forge", r"\b(gh[ousr]_[A-Za-z0-9_]{36,255})\b", cwe=("CWE-798",), hints=("gho_", "ghu_", "ghs_", "ghr_")),
    Rule("SECRET-005", *_S, "CRITICAL", 95, "token of a build server", r"\b(glpat-[0-9a-zA-Z\-_]{20,})\b", cwe=("CWE-798",), hints=("glpat-",)),
    Rule("SECRET-006", *_S, "HIGH", 90, "map service key", r"\b(AIza[0-9A-Za-z\-_]{35})\b", cwe=("CWE-798",), hints=("AIza",)),
    Rule("SECRET-007", *_S, "CRITICAL", 98, "live payment key", r"\b(sk_live_[0-9a-zA-Z]{24,}|rk_live_[0-9a-zA-Z]{24,})\b", cwe=("CWE-798",), hints=("k_live_",)),
    Rule("SECRET-008", *_S, "HIGH", 95, "chat token", r"\b(xox[baprs]-[0-9]{10,13}-[0-9]{10,13}-[a-zA-Z0-9]{24,32})\b", cwe=("CWE-798",), hints=("xox",)),
    Rule("SECRET-009", *_S, "MEDIUM", 95, "chat web hook", r"https://hooks\.slack\.com/services/T[A-Z0-9_]{8,12}/B[A-Z0-9_]{8,12}/[A-Za-z0-9_]{24}", cwe=("CWE-798",), group=0, hints=("hooks.slack.com",)),
    Rule("SECRET-010", *_S, "HIGH", 90, "chat bot token or web hook", r"(?i)(?:https://discord(?:app)?\.com/api/webhooks/[0-9]{17,20}/[A-Za-z0-9_-]{60,68}|(?:discord[_-]?token|bot[_-]?token)\s*[:=]\s*['\"][MNO][a-zA-Z0-9_-]{23,25}\.[a-zA-Z0-9_-]{6}\.[a-zA-Z0-9_-]{27}['\"])", cwe=("CWE-798",), group=0),
    Rule("SECRET-011", *_S, "HIGH", 92, "messenger bot token", r"\b([0-9]{8,10}:[a-zA-Z0-9_-]{35})\b", cwe=("CWE-798",)),
    Rule("SECRET-013", *_S, "LOW", 85, "signed web token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", cwe=("CWE-522",), group=0, hints=("eyJ",)),
    Rule("SECRET-014", *_S, "HIGH", 92, "database address with password", r"(?i)(?:postgres|postgresql|mysql|mongodb(?:\+srv)?|redis|mssql)://[a-zA-Z0-9_.-]+:([^@\s:]{4,})@[a-zA-Z0-9_.-]+", cwe=("CWE-798",), hints=("://",)),
    Rule("SECRET-015", *_S, "MEDIUM", 75, "generic key assigned", r"(?i)(?:api[_-]?key|client[_-]?secret|db[_-]?password|app[_-]?secret|auth[_-]?token)\s*[:=]\s*['\"]([^'\"\s]{16,64})['\"]", cwe=("CWE-798",), min_entropy=3.8),
)
#: Spans lines, so it runs on whole contents.
KEY_BLOCK = Rule("SECRET-012", *_S, "CRITICAL", 99, "private key block", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----", cwe=("CWE-321",), group=0)

# Patterns of unsafe lines.
_SEC, _SAST = "Security", "sast"
CODE = (
    Rule("SEC-001", _SAST, _SEC, "CRITICAL", 90, "shell command through os", r"\bos\.(?:system|popen)\s*\(", ("python",), cwe=("CWE-78",)),
    Rule("SEC-001", _SAST, _SEC, "CRITICAL", 95, "subprocess with a shell", r"(?i)\bsubprocess\.(?:run|call|check_call|check_output|Popen)\s*\([^)]*shell\s*=\s*True", ("python",), cwe=("CWE-78",)),
    Rule("SEC-002", _SAST, _SEC, "CRITICAL", 90, "text evaluated as code", r"\b(?:eval|exec)\s*\(", ("python",), cwe=("CWE-95",)),
    Rule("SEC-007", _SAST, _SEC, "CRITICAL", 95, "pickle of foreign data", r"\bpickle\.(?:loads|load)\s*\(", ("python",), cwe=("CWE-502",)),
    Rule("SEC-007", _SAST, _SEC, "HIGH", 85, "unsafe yaml loader", r"\byaml\.load\s*\(", ("python",), cwe=("CWE-502",), excluded="safe_load"),
    Rule("SEC-003", _SAST, _SEC, "CRITICAL", 90, "query text put together", r"(?i)\b(?:cursor|db|session)\.execute\s*\(\s*(?:f[\"']|[\"'].*?%|[\"'].*?\.format\()", ("python",), cwe=("CWE-89",)),
    Rule("MAL-003", _SAST, "Malware", "CRITICAL", 95, "terminal of an interactive shell", r"(?i)\bpty\.spawn\s*\(\s*[\"']/(?:bin|usr/bin)/(?:bash|sh|zsh)[\"']\s*\)", ("python",), cwe=("CWE-506",)),
    Rule("SEC-001", _SAST, _SEC, "CRITICAL", 85, "shell command in a web script", r"\b(?:system|exec|shell_exec|passthru|proc_open|popen)\s*\(|`[^`]+`", ("php",), cwe=("CWE-78",)),
    Rule("SEC-002", _SAST, _SEC, "CRITICAL", 95, "text evaluated in a web script", r"\b(?:eval|assert)\s*\(", ("php",), cwe=("CWE-95",)),
    Rule("SEC-007", _SAST, _SEC, "CRITICAL", 95, "request data turned into objects", r"(?i)\bunserialize\s*\([^)]*\$_(?:GET|POST|REQUEST|COOKIE)", ("php",), cwe=("CWE-502",)),
    Rule("SEC-005", _SAST, _SEC, "HIGH", 90, "request data names an included file", r"(?i)\b(?:include|require|include_once|require_once)\s*\(?\s*.*\$_(?:GET|POST|REQUEST)", ("php",), cwe=("CWE-98",)),
    Rule("MAL-002", _SAST, "Malware Indicator", "CRITICAL", 95, "download piped to a shell", r"(?i)(?:curl|wget)\s+[^|]+\|\s*(?:ba)?sh\b", cwe=("CWE-494",)),
    Rule("MAL-001", _SAST, "Malware Indicator", "CRITICAL", 95, "encoded command", r"(?i)(?:powershell|pwsh)(?:\.exe)?\s+.*-(?:enc|encodedcommand)\s+[A-Za-z0-9+/=]{10,}", cwe=("CWE-506",)),
    Rule("SEC-001", _SAST, _SEC, "HIGH", 85, "command line given to a shell", r"(?i)exec\.Command\s*\(\s*[\"'](?:sh|bash|cmd)[\"']\s*,\s*[\"']-[cC][\"']", ("go",), cwe=("CWE-78",)),
    Rule("SEC-001", _SAST, _SEC, "HIGH", 80, "process started from the runtime", r"(?i)Runtime\.getRuntime\(\)\.exec\s*\(", ("java",), cwe=("CWE-78",)),
    Rule("SEC-001", _SAST, _SEC, "HIGH", 85, "copy without bounds", r"\b(?:gets|strcpy|sprintf)\s*\(", ("c", "cpp"), cwe=("CWE-120",)),
)
TEXT = (
    Rule("MAL-003", "malware", "Malware", "CRITICAL", 95, "shell bound to a network socket", r"(?i)(?:bash\s+-i\s+>&|/dev/tcp/[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}/[0-9]+|nc\s+(?:-e|--exec)\s+/bin/(?:ba)?sh|socket\.socket\(socket\.AF_INET,\s*socket\.SOCK_STREAM\).*s\.connect)", classification="confirmed_malware", cwe=("CWE-506",)),
    Rule("MAL-004", "malware", "Malware Indicator", "HIGH", 85, "start-up entry written", r"(?i)(?:crontab\s+-[le]|echo\s+[\"'].*[\"']\s*>>\s*/etc/cron|reg\s+add\s+[\"']HK(?:LM|CU)\\Software\\Microsoft\\Windows\\CurrentVersion\\Run)", classification="suspicious", cwe=("CWE-506",)),
)
CONFIG = (
    Rule("MAL-002", "configuration", "Configuration", "CRITICAL", 95, "image build pipes a download to a shell", r"(?i)^RUN\s+.*(?:curl|wget)\s+[^|]+\|\s*(?:ba)?sh", ("dockerfile",), cwe=("CWE-494",)),
    Rule("CONFIG-002", "configuration", "Configuration", "HIGH", 95, "privileged container", r"(?i)privileged\s*:\s*true", ("yaml",), cwe=("CWE-250",)),
    Rule("CONFIG-003", "configuration", "Configuration", "HIGH", 90, "host socket or path mounted", r"(?i)/var/run/docker\.sock|hostPath\s*:", ("yaml",), cwe=("CWE-250",)),
)

# Found by file, join or program rather than by a line.
OTHERS = (
    Rule("SEC-004", _SAST, _SEC, "HIGH", 85, "markup set from text", cwe=("CWE-79",)),
    Rule("SEC-006", _SAST, _SEC, "HIGH", 80, "request to an address from outside", cwe=("CWE-918",)),
    Rule("SEC-008", _SAST, _SEC, "MEDIUM", 95, "weak cipher", cwe=("CWE-327",)),
    Rule("SEC-009", _SAST, _SEC, "HIGH", 80, "prototype changed from outside", cwe=("CWE-1321",)),
    Rule("SEC-010", _SAST, _SEC, "MEDIUM", 80, "redirect to an address from outside", cwe=("CWE-601",)),
    Rule("SEC-011", _SAST, _SEC, "MEDIUM", 80, "open cross-origin rule with credentials", cwe=("CWE-942",)),
    Rule("SEC-012", _SAST, _SEC, "HIGH", 80, "token read without a check", cwe=("CWE-345",)),
    Rule("MAL-005", "malware", "Malware Indicator", "CRITICAL", 95, "program under another name", classification="potentially_malicious", cwe=("CWE-506",)),
    Rule("MAL-006", "malware", "Malware", "CRITICAL", 99, "known hash", classification="confirmed_malware", cwe=("CWE-506",)),
    Rule("SUSP-001", "suspicious", "Suspicious", "HIGH", 85, "decoded text evaluated", cwe=("CWE-506",)),
    Rule("SUSP-002", "suspicious", "Suspicious", "MEDIUM", 70, "large literal of high entropy", cwe=("CWE-506",)),
    Rule("SUSP-003", "suspicious", "Suspicious", "MEDIUM", 70, "raw socket", cwe=("CWE-506",)),
    Rule("SUSP-004", "suspicious", "Potentially Dangerous", "HIGH", 85, "install hook runs a shell", cwe=("CWE-506",)),
    Rule("CONFIG-001", "configuration", "Configuration", "MEDIUM", 85, "image runs as root", cwe=("CWE-250",)),
    Rule("CONFIG-004", "configuration", "Configuration", "CRITICAL", 95, "privileged workflow checks out foreign code", cwe=("CWE-94",)),
    Rule("CONFIG-005", "configuration", "Configuration", "LOW", 80, "workflow step without fixed version", cwe=("CWE-829",)),
    Rule("CONFIG-006", "configuration", "Configuration", "HIGH", 90, "administration port open to all", cwe=("CWE-284",)),
    Rule("CONFIG-007", "configuration", "Configuration", "MEDIUM", 95, "environment file in the tree", cwe=("CWE-538",)),
)
EXTRA = (
    Rule("MAL-CHAIN-001", _SAST, "Malware", "CRITICAL", 96, "credentials read, then sent away", classification="confirmed_malware", cwe=("CWE-506",)),
    Rule("DEP-002", "dependencies", "Malware Indicator", "CRITICAL", 95, "install hook downloads code", classification="potentially_malicious", cwe=("CWE-506",)),
    Rule("PERM-001", "permissions", "Permissions", "HIGH", 90, "secret file writable by all", classification="needs_review", cwe=("CWE-732",)),
    Rule("PERM-002", "permissions", "Permissions", "MEDIUM", 75, "script writable by all", classification="needs_review", cwe=("CWE-732",)),
)
LINE_RULES = CODE + TEXT + CONFIG


def registry() -> list[Rule]:
    """Every declared rule id once, in order."""
    return list({r.rule_id: r for r in reversed([*SECRETS, KEY_BLOCK, *CODE, *TEXT, *CONFIG, *OTHERS])}.values())[::-1]


def by_id(rule_id: str) -> Rule:
    return next(r for r in [*registry(), *EXTRA] if r.rule_id == rule_id)


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(r.rule_id, r.title, r.scanner, r.category, r.severity, r.confidence, list(r.cwe), r.min_entropy) for r in registry()]
    return spark.createDataFrame(rows, "rule_id string, name string, scanner string, category string, severity string, confidence int, cwe array<string>, min_entropy double")
