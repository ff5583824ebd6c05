"""Rows for unit tests: one function per table, missing fields as a source leaves them."""

from datetime import datetime, timezone

from sentryframe.schemas import TABLE_SCHEMAS, Telemetry

_N = 0


def _row(event_type, fields):
    global _N
    _N += 1
    base = {"event_id": f"{event_type[0]}{_N:05d}", "timestamp": "2024-01-01 00:00:00", "event_type": event_type,
            "device": "PC01", "user": "amy", "source": "test"}
    chosen = {**base, **fields}
    stamp = chosen["timestamp"]
    if isinstance(stamp, str):
        chosen["timestamp"] = datetime.fromisoformat(stamp).replace(tzinfo=timezone.utc)
    return tuple(
        chosen.get(f.name, "" if f.dataType.typeName() == "string" else None) for f in TABLE_SCHEMAS[event_type].fields)


def process(**fields):
    return _row("process", fields)


def network(**fields):
    return _row("network", {"direction": "outbound", "process_name": "powershell.exe", **fields})


def logon(**fields):
    return _row("logon", {"action": "success", "logon_type": 3, **fields})


def control(**fields):
    return _row("control", {"source": "cloudtrail_mgmt", "decision": "allowed", **fields})


def telemetry(spark, processes=(), networks=(), logons=(), controls=()):
    make = lambda rows, name: spark.createDataFrame(list(rows), TABLE_SCHEMAS[name])
    return Telemetry(make(processes, "process"), make(networks, "network"), make(logons, "logon"), make(controls, "control"))
