"""Names, word lists and patterns whose exact content decides results.

Everything here is data.  The operators read it; none of it is computed.
"""

# Event tables ---------------------------------------------------------------------------
PROCESS, NETWORK, LOGON, CONTROL = "process", "network", "logon", "control"
EVENT_TYPES = (PROCESS, NETWORK, LOGON, CONTROL)

# Severities, weakest first; the position is the rank.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SEVERITY_RANK = {name: rank for rank, name in enumerate(SEVERITIES)}

# Windows logon types (fixed values).
LOGON_TYPE_NAMES = {
    2: "Interactive (console)",
    3: "Network (SMB / share access)",
    4: "Batch (scheduled task)",
    5: "Service",
    7: "Unlock",
    8: "NetworkCleartext",
    9: "NewCredentials (runas /netonly)",
    10: "RemoteInteractive (RDP)",
    11: "CachedInteractive",
}
REMOTE_LOGON_TYPES = (3, 10)
INTERACTIVE_LOGON_TYPES = (2, 7, 10, 11)
OWNERSHIP_LOGON_TYPES = (2, 7, 11)
SERVICE_LOGON_TYPE = 5

# Signature states (fixed values).
SIGNATURE_STATES = ("valid", "invalid", "unsigned", "unknown")

# Control-plane verbs by class (fixed values).  A verb in no list is "other".
VERBS_BY_CLASS = {
    "read": (
        "get", "list", "describe", "lookup", "search", "query", "scan", "check", "view",
        "discover", "simulate", "decode", "validate", "test", "resolve", "translate",
        "estimate", "preview", "head", "download", "select", "watch",
    ),
    "create": (
        "create", "put", "generate", "copy", "import", "register", "allocate", "request",
        "provision", "restore", "upload", "clone", "issue",
    ),
    "grant": (
        "attach", "add", "authorize", "associate", "grant", "share", "shared", "bind",
        "allow",
    ),
    "revoke": (
        "detach", "remove", "revoke", "disassociate", "deny", "reject", "unshare",
        "unbind",
    ),
    "modify": (
        "modify", "update", "set", "change", "replace", "enable", "disable", "activate",
        "deactivate", "rotate", "resize", "tag", "untag", "reset", "configure", "move",
        "rename", "monitor", "unmonitor", "patch", "apply",
    ),
    "delete": (
        "delete", "terminate", "destroy", "purge", "discard", "cancel", "release",
        "deregister", "unregister", "deletecollection", "expire",
    ),
    "execute": (
        "run", "start", "stop", "restart", "reboot", "invoke", "exec", "execute", "send",
        "publish", "deliver", "initiate", "trigger", "abort", "connect", "proxy",
    ),
}
VERB_CLASS_NAMES = (*VERBS_BY_CLASS, "other")
AUTHORITY_CHANGING_CLASSES = ("grant", "revoke", "create", "delete", "modify")
RBAC_BINDING_RESOURCES = ("rolebindings", "clusterrolebindings")
IDENTITY_SERVICES = ("iam",)

# Decisions (fixed values).
ALLOWED, DENIED, FAILED = "allowed", "denied", "failed"
AUTHORIZATION_ERROR_TOKENS = (
    "accessdenied", "unauthorized", "forbidden", "notauthorized", "authfailure",
    "invalidclienttokenid", "expiredtoken", "signaturedoesnotmatch",
    "invalididentitytoken", "unrecognizedclient",
)
AUTHORIZATION_HTTP_STATUSES = (401, 403)
PROTOCOL_UPGRADE_STATUS = 101

# Process images (fixed values).
SCRIPT_INTERPRETERS = (
    "powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe",
    "rundll32.exe", "regsvr32.exe", "wmic.exe", "bitsadmin.exe", "certutil.exe",
    "msbuild.exe", "installutil.exe",
)
OFFICE_APPLICATIONS = (
    "winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe",
    "onenote.exe", "visio.exe", "mspub.exe", "soffice.exe", "soffice.bin",
)
MAIL_OPENED_OFFICE_APPLICATIONS = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe")
MACRO_EXTENSIONS = (".docm", ".dotm", ".xlsm", ".xlsb", ".pptm", ".ppsm")
SERVICE_SHELLS = ("cmd.exe", "powershell.exe", "pwsh.exe")
DISCOVERY_BINARIES = {
    "whoami.exe": "T1033",
    "net.exe": "T1069.002",
    "nltest.exe": "T1482",
    "systeminfo.exe": "T1033",
    "hostname.exe": "T1033",
    "quser.exe": "T1033",
}
SECURITY_PRODUCTS = {
    "msmpeng.exe": "Microsoft Defender Antivirus",
    "mssense.exe": "Microsoft Defender for Endpoint sensor",
    "senseir.exe": "Microsoft Defender for Endpoint response",
    "ccmexec.exe": "Microsoft Configuration Manager (patch management)",
    "sysmon.exe": "Sysinternals Sysmon",
    "sysmon64.exe": "Sysinternals Sysmon",
    "carbonblack.exe": "VMware Carbon Black",
    "csfalconservice.exe": "CrowdStrike Falcon",
    "xagt.exe": "Trellix/FireEye HX",
    "sentinelagent.exe": "SentinelOne",
    "wazuh-agent.exe": "Wazuh",
    "splunkd.exe": "Splunk forwarder",
}
WINDOWS_MARKER_IMAGES = (
    "svchost.exe", "lsass.exe", "services.exe", "explorer.exe", "winlogon.exe",
)

# Command-line patterns (fixed values), matched on lower-cased text.
EVASION_FLAGS = (
    ("hidden window", r"(?:^|\s)[-/]w(?:indowstyle)?\s+hidden"),
    ("no profile", r"(?:^|\s)[-/]nop(?:rofile)?(?:\s|$)"),
    ("execution policy bypass", r"(?:^|\s)[-/]e(?:x|xecutionpolicy)?\s+bypass"),
)
DOWNLOAD_INDICATORS = (
    "downloadstring", "downloadfile", "downloaddata", "invoke-webrequest",
    "invoke-restmethod", "iex", "invoke-expression", "start-bitstransfer",
    "net.webclient", "http://", "https://", "frombase64string",
)
LSASS_ARGUMENT_PATTERN = ("explicit lsass reference", r"\blsass(\.exe|\.dmp)?\b")
LSASS_PATTERNS = (
    ("comsvcs.dll MiniDump", r"comsvcs\.dll.{0,40}minidump"),
    LSASS_ARGUMENT_PATTERN,
    ("procdump against lsass", r"procdump(64)?\.exe.{0,60}lsass"),
    ("mimikatz sekurlsa module", r"sekurlsa::"),
    ("credential dump keyword", r"\b(lsadump|dumpcreds|logonpasswords)\b"),
    ("rundll32 MiniDump export", r"rundll32.{0,80}\bminidump\b"),
)
RECOVERY_PROCEDURES = (
    ("shadow_copy_deletion", r"\bdelete\b[^|;&]{0,40}?\bshadows?\b",
     "shadow copies wiped"),
    ("shadow_copy_deletion_wmi", r"\bshadowcopy\b[^|;&]{0,40}?\bdelete\b",
     "WMI call that deletes shadow copies"),
    ("backup_catalog_deletion", r"\bdelete\b[^|;&]{0,40}?\bcatalog\b",
     "catalog of backups wiped"),
    ("backup_deletion", r"\bdelete\b[^|;&]{0,40}?\bsystemstatebackup\b",
     "system state backups wiped"),
    ("recovery_environment_disabled", r"\breagentc(\.exe)?\b[^|;&]{0,40}?/disable\b",
     "recovery partition switched off"),
    ("boot_recovery_disabled", r"\brecoveryenabled\b\s+no\b",
     "no repair at boot"),
    ("boot_failure_policy_ignored", r"\bbootstatuspolicy\b\s+ignoreallfailures\b",
     "boot failures ignored"),
)
RECOVERY_ENUMERATION = (
    ("shadow_copy_enumeration", r"\blist\b[^|;&]{0,40}?\bshadows?\b"),
    ("backup_enumeration",
     r"\bwbadmin(\.exe)?\b[^|;&]{0,40}?\bget\b[^|;&]{0,40}?\b(versions|status)\b"),
)
SECURITY_TOOL_PROCEDURES = (
    ("security_process_killed",
     r"/im\s+\"?(msmpeng|mssense|senseir|csfalconservice|xagt|sentinelagent|"
     r"carbonblack|wazuh-agent)\w*\.exe",
     "protection process killed"),
    ("security_service_stopped",
     r"\bstop\b\s+\"?(windefend|sense|wdnissvc|mpssvc|csagent|sentinelagent|wazuh)\b",
     "protection service stopped"),
    ("defender_realtime_disabled", r"-disablerealtimemonitoring\s+\$?true",
     "live scanning switched off"),
    ("defender_exclusion_added", r"-exclusion(path|extension|process)\b",
     "path or type left out of scans"),
    ("security_service_disabled_registry",
     r"\\(windefend|sense|sentinelagent)\b[^|;&]{0,60}?\bstart\b[^|;&]{0,20}?\b4\b",
     "protection service disabled in the registry"),
    ("firewall_disabled", r"\bfirewall\b[^|;&]{0,60}?\bstate\s+off\b",
     "local firewall off"),
)
ADMIN_SHARE_REDIRECT = r"(?i)\\\\[^\\]+\\(admin\$|c\$|ipc\$)"
ADMIN_SHARE_REFERENCE = r"(?i)\\\\[^\\\s]+\\(?:ADMIN\$|C\$|IPC\$)"
ARCHIVE_TOOLS = (
    r"(?i)\b(compress-archive|7z(a|r)?\.exe|winrar\.exe|rar\.exe|tar\.exe|makecab\.exe"
    r"|zip\.exe|\[io\.compression\.zipfile\])\b"
)
STAGING_PATHS = (
    r"(?i)(c:\\windows\\temp|c:\\temp|c:\\users\\public|\\appdata\\local\\temp"
    r"|c:\\programdata|\\\$recycle\.bin)"
)
BULK_SOURCE = r"(?i)-path\s+\S*\*|\s\S+\\\*(\s|$)"
ENCODED_COMMAND_WORD = "encodedcommand"

# Privilege grants (fixed values).
HIGH_PRIVILEGE_ROLES = ("cluster-admin", "admin")
SUPERUSER_GROUPS = ("system:masters",)

# Text vocabulary of the calibration check (fixed values) lives in functions.text.
