"""Scoring and allowlist dimensions: fixed values as the default, or a configuration file's."""

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

# Scores by component, first match in this order.
COMPONENTS = {
    "Windows Kernel": 38, "Win32k": 35, "NTFS": 32, "Windows Hyper-V": 30, "Windows LDAP": 28, "Windows Remote Desktop": 28, "Windows DNS": 26, "Windows SMB": 26, "Windows OLE": 24, "Windows Print Spooler": 22,
    "Microsoft Exchange": 20, "Microsoft Office": 18, "Windows Defender": 16, "Windows Installer": 14, "Microsoft Edge": 10,
}
CWE = {"CWE-122": 22, "CWE-787": 22, "CWE-416": 22, "CWE-190": 18, "CWE-125": 16, "CWE-20": 14, "CWE-269": 12, "CWE-287": 10}
IMPACT = {"Remote Code Execution": 18, "Elevation of Privilege": 12, "Security Feature Bypass": 10, "Information Disclosure": 8, "Denial of Service": 6, "Spoofing": 3}
VECTOR = {"Network": 15, "Adjacent": 10, "Local": 8, "Physical": 3}
PRIVILEGES = {"None": 10, "Low": 5, "High": 2}
INTERACTION = {"None": 8, "Required": 3}
BONUSES = {"customer_action_required": 15, "exploit_active": 20, "kev_listed": 25}
THRESHOLDS = {"HIGH": 80, "MEDIUM": 45, "LOW": 15}
IGNORED = ("Azure Linux", "Chromium", "Android", "iOS", "Linux Kernel", "Mariner")

# The research score; the best match over component and title.
VR_COMPONENTS = {
    "MSHTML": 38, "JScript": 38, "Scripting Engine": 38, "Chakra": 38, "Microsoft Graphics Component": 38, "Windows GDI": 36, "DirectWrite": 35, "Windows Font": 35, "OpenType": 35, "TrueType": 35, "Windows Uniscribe": 35,
    "Internet Explorer": 35, "Windows OLE": 32, "Windows Codecs Library": 32, "Windows Imaging Component": 32, "HEVC Video Extensions": 32, "AV1 Video Extension": 32, "Microsoft Outlook": 32, "Microsoft Office": 32, "Microsoft Word": 32,
    "Microsoft Excel": 32, "Windows RPC": 30, "Remote Procedure Call": 30, "Windows DCOM": 30, "Windows COM": 30, "Windows Script": 30, "Windows DNS": 30, "Microsoft Edge": 30, "Rich Text": 30, "Windows Shell": 30, "Windows TCP/IP": 28,
    "Windows SMB": 28, "LDAP": 28, "Windows HTTP": 28, "Windows Media": 28, "Windows Print Spooler": 25, "Windows Task Scheduler": 25, "Windows Installer": 25, "Windows Message Queuing": 25, "Windows DHCP": 25, "Windows Defender": 25,
    "Windows XPS": 25, "Windows Compressed Folder": 28, "Windows Token": 22, "Windows LSA": 22, "Windows SAM": 22, "Kerberos": 22, "Windows NTLM": 22, "Windows ACL": 20, "Windows Authentication": 20, "Windows Credentials": 20,
    "Windows Security": 18, "Windows Storage": 18, "Windows Fax": 22, "Windows Address Book": 22, "Windows Contacts": 22, "win32k": 15, "Windows AppContainer": 15, "Windows Kernel": 8, "Windows Common Log File System": 10, "Windows CLFS": 10,
    "NTFS": 10, "Windows Driver": 5, "Windows Hyper-V": 8,
}
VR_CATCHALL = {"Azure": 3, "Visual Studio": 8, "SQL Server": 5, "SharePoint": 5, "Exchange": 5, "Teams": 8, "OneDrive": 8}
VR_DEFAULT = 5
VR_CWE = {
    "CWE-122": 22, "CWE-787": 22, "CWE-416": 22, "CWE-415": 22, "CWE-190": 20, "CWE-843": 20, "CWE-191": 18, "CWE-125": 16, "CWE-119": 16, "CWE-362": 16, "CWE-120": 14, "CWE-121": 14, "CWE-476": 6, "CWE-77": 10, "CWE-78": 10, "CWE-502": 8,
    "CWE-20": 8, "CWE-269": 3, "CWE-287": 2,
}
VR_IMPACT = {"Remote Code Execution": 18, "Elevation of Privilege": 16, "Security Feature Bypass": 10, "Information Disclosure": 14, "Denial of Service": 4, "Spoofing": 3}
VR_VECTOR = {"N": 15, "A": 10, "L": 8, "P": 2}
VR_PRIVILEGES = {"N": 12, "L": 6, "H": 0}
VR_INTERACTION = {"N": 8, "R": 4}
VR_BONUSES = {"customer_action_required": 15, "exploit_unproven": 5, "exploit_active": -15, "publicly_disclosed": -5, "critical_severity": 10, "important_severity": 3, "scope_changed": 12}
VR_THRESHOLDS = {"PRIME": 100, "HIGH": 70, "MEDIUM": 45, "LOW": 20}
MEM_CORRUPT = ("CWE-122", "CWE-787", "CWE-416", "CWE-190", "CWE-843", "CWE-415", "CWE-191", "CWE-125", "CWE-119", "CWE-120", "CWE-121", "CWE-362")
HEAP_CORRUPT = ("CWE-122", "CWE-416", "CWE-415", "CWE-843", "CWE-787", "CWE-190", "CWE-191")
PARSERS = (
    "MSHTML", "JScript", "Scripting Engine", "Chakra", "Graphics Component", "GDI", "DirectWrite", "Font", "OpenType", "TrueType", "Uniscribe", "Codecs", "Imaging Component", "HEVC", "AV1", "Windows Media", "Microsoft Office",
    "Microsoft Word", "Microsoft Excel", "Rich Text", "Internet Explorer", "Windows OLE", "Windows Shell", "Windows Defender", "Windows COM", "Windows Fax", "Windows XPS", "Compressed Folder",
)
KERNEL = ("Windows Kernel", "win32k", "CLFS", "Common Log File", "NTFS", "Windows Driver", "AppContainer")

# Hosts and addresses that are no indicators.
ALLOWED_DOMAINS = (
    "microsoft.com", "google.com", "cisa.gov", "cloudflare.com", "amazonaws.com", "azure.com", "windows.net", "office365.com", "live.com", "outlook.com", "github.com", "cloudfront.net", "akamaiedge.net", "digicert.com", "verisign.com",
    "letsencrypt.org", "mozilla.org", "apple.com", "ubuntu.com", "debian.org", "windowsupdate.com", "microsoftonline.com", "office.com",
)
ALLOWED_IPS = ("8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9")


def allowlist(spark: SparkSession, domains: tuple[str, ...] = ALLOWED_DOMAINS, ips: tuple[str, ...] = ALLOWED_IPS, hashes: tuple[str, ...] = ()) -> DataFrame:
    """(kind, key)."""
    return spark.createDataFrame([("domain", d) for d in domains] + [("ip", i) for i in ips] + [("hash", h) for h in hashes], "kind string, key string")


def ordered(spark: SparkSession, scores: dict[str, int]) -> DataFrame:
    """(pos, name, score) of a mapping whose order counts."""
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(scores.items())], "pos int, name string, score int")


@dataclass(frozen=True)
class Scoring:
    """What the scores are computed from. Mappings keep their order: the first component that fits counts."""

    components: dict[str, int] = field(default_factory=lambda: dict(COMPONENTS))
    cwe: dict[str, int] = field(default_factory=lambda: dict(CWE))
    impact: dict[str, int] = field(default_factory=lambda: dict(IMPACT))
    vector: dict[str, int] = field(default_factory=lambda: dict(VECTOR))
    privileges: dict[str, int] = field(default_factory=lambda: dict(PRIVILEGES))
    interaction: dict[str, int] = field(default_factory=lambda: dict(INTERACTION))
    bonuses: dict[str, int] = field(default_factory=lambda: dict(BONUSES))
    thresholds: dict[str, int] = field(default_factory=lambda: dict(THRESHOLDS))
    ignored: tuple[str, ...] = IGNORED
    vr_components: dict[str, int] = field(default_factory=lambda: dict(VR_COMPONENTS))
    vr_catchall: dict[str, int] = field(default_factory=lambda: dict(VR_CATCHALL))
    vr_default: int = VR_DEFAULT
    vr_cwe: dict[str, int] = field(default_factory=lambda: dict(VR_CWE))
    vr_impact: dict[str, int] = field(default_factory=lambda: dict(VR_IMPACT))
    vr_vector: dict[str, int] = field(default_factory=lambda: dict(VR_VECTOR))
    vr_privileges: dict[str, int] = field(default_factory=lambda: dict(VR_PRIVILEGES))
    vr_interaction: dict[str, int] = field(default_factory=lambda: dict(VR_INTERACTION))
    vr_bonuses: dict[str, int] = field(default_factory=lambda: dict(VR_BONUSES))
    vr_thresholds: dict[str, int] = field(default_factory=lambda: dict(VR_THRESHOLDS))
    mem_corrupt: tuple[str, ...] = MEM_CORRUPT
    heap_corrupt: tuple[str, ...] = HEAP_CORRUPT
    parsers: tuple[str, ...] = PARSERS
    kernel: tuple[str, ...] = KERNEL

    @property
    def version(self) -> str:
        """Eight digits that tell two configurations apart, order included."""
        return hashlib.sha256(json.dumps(asdict(self)).encode()).hexdigest()[:8]


DEFAULT = Scoring()

# Where a configuration file holds each part.
PLACES = {
    "components": ("component_scores",), "cwe": ("cwe_weights",), "impact": ("impact_weights",), "vector": ("attack_vector",), "privileges": ("privileges_required",), "interaction": ("user_interaction",), "bonuses": ("bonuses",),
    "thresholds": ("priority_thresholds",), "ignored": ("ignore_list",), "vr_components": ("vr_scoring", "components"), "vr_catchall": ("vr_scoring", "catchall_categories"), "vr_default": ("vr_scoring", "default_component_score"),
    "vr_cwe": ("vr_scoring", "cwe_weights"), "vr_impact": ("vr_scoring", "impact_weights"), "vr_vector": ("vr_scoring", "attack_vector_weights"), "vr_privileges": ("vr_scoring", "privileges_required_weights"),
    "vr_interaction": ("vr_scoring", "user_interaction_weights"), "vr_bonuses": ("vr_scoring", "bonuses"), "vr_thresholds": ("vr_scoring", "thresholds"), "mem_corrupt": ("vr_scoring", "tag_rules", "mem_corrupt", "cwe_ids"),
    "heap_corrupt": ("vr_scoring", "tag_rules", "heap_corrupt", "cwe_ids"), "parsers": ("vr_scoring", "tag_rules", "user_mode_parser", "component_patterns"), "kernel": ("vr_scoring", "tag_rules", "kernel", "component_patterns"),
}


def _yaml(spark: SparkSession, path: str) -> dict:
    import yaml

    found = spark.read.text(path, wholetext=True).first()  # an empty file has no row
    return yaml.safe_load(found[0] if found else "") or {}


def load_dims(spark: SparkSession, path: str) -> Scoring:
    """The scoring tables of a configuration file, wherever Spark reads it; parts that it lacks are as they are here.

    Whole parts are replaced. Bonuses that a file's part lacks count nothing. A
    part of another form than it must have raises, named by its place.
    """
    given, parts = _yaml(spark, path), {}
    for name, place in PLACES.items():
        at = given
        for step in place:
            at = at.get(step) if isinstance(at, dict) else None
        if at is None:
            continue
        default = getattr(DEFAULT, name)
        if isinstance(default, dict):
            if not isinstance(at, dict) or not all(isinstance(v, int) for v in at.values()):
                raise ValueError(f"{'.'.join(place)} must map names to whole numbers")
            known = dict.fromkeys(default, 0) if name.endswith("bonuses") else {}
            # thresholds are tried from the highest
            parts[name] = dict(sorted(at.items(), key=lambda x: -x[1])) if name.endswith("thresholds") else known | at
        elif isinstance(default, tuple):
            if not isinstance(at, list):
                raise ValueError(f"{'.'.join(place)} must be a list")
            parts[name] = tuple(map(str, at))
        elif isinstance(at, int):
            parts[name] = at
        else:
            raise ValueError(f"{'.'.join(place)} must be a whole number")
    return replace(DEFAULT, **parts)


def load_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key) of a configuration file's domains, ips and hashes."""
    given = _yaml(spark, path)
    return allowlist(spark, *[tuple(str(x).lower() for x in given.get(k) or ()) for k in ("domains", "ips", "hashes")])
