"""What the telemetry says about the environment: profiles, inventories, platforms.

Wide sets (hosts of an image, peers of a host) stay as rows of bridge tables; a profile
carries their sizes.  Every profile first reduces events to distinct combinations, so a
busy image or address shrinks before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.network import is_public_ip
from ..schemas import Telemetry
from ..vocab import EVENT_TYPES


def _full(value: str | Column) -> Column:
    """The value, or null when it is the empty string."""
    column = F.col(value) if isinstance(value, str) else value
    return F.nullif(column, F.lit(""))


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- A01


def table_counts(tel: Telemetry) -> DataFrame:
    return _union([
        df.groupBy().agg(
            F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
            F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
        for name, df in tel.tables().items()
    ])


def distinct_entities(tel: Telemetry) -> DataFrame:
    """Devices and users seen in any table."""
    pairs = _union([df.select("device", "user").distinct() for df in tel.tables().values()])
    return pairs.agg(
        F.countDistinct(_full("device")).alias("devices"), F.countDistinct(_full("user")).alias("users"))


def top_images(tel: Telemetry, top: int = 10) -> DataFrame:
    return (
        tel.processes.groupBy("process_name").agg(F.count(F.lit(1)).alias("executions"))
        .orderBy(F.col("executions").desc(), "process_name").limit(top))


def logon_outcomes(tel: Telemetry) -> DataFrame:
    return tel.logons.groupBy("device", "action").agg(F.count(F.lit(1)).alias("logons"))


# ---------------------------------------------------------------- A02-A04


def _windowed(reduced: DataFrame, key: str, bounds: DataFrame) -> list[Column]:
    """Reach overall and in the last quarter of the observed span, from reduced rows.

    ``reduced`` has one row per (key, device, ...) with ``first`` and ``last``.
    """
    lo, hi = (bounds.select(F.unix_micros(c)).scalar() for c in ("lo", "hi"))
    cut = hi - (hi - lo) / 4
    return [
        F.countDistinct("device").alias("overall_hosts"),
        F.countDistinct(F.when(F.unix_micros("last") >= cut, F.col("device"))).alias("recent_hosts"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
    ]


def _prevalence_flags(profile: DataFrame, bounds: DataFrame) -> DataFrame:
    lo, hi = (bounds.select(F.unix_micros(c)).scalar() for c in ("lo", "hi"))
    span = F.unix_micros("last_seen") - F.unix_micros("first_seen")
    return profile.withColumn(
        "is_emerging",
        (F.col("recent_hosts") >= 2) & (F.col("recent_hosts") > F.col("overall_hosts") * 0.75),
    ).withColumn("is_established", (hi > lo) & (span >= (hi - lo) * 0.5))


def _bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))


def public_connections(network: DataFrame) -> DataFrame:
    return network.where(is_public_ip(F.col("remote_ip")))


def destination_hosts(network: DataFrame) -> DataFrame:
    """Bridge: ``remote_ip, device, user, image`` with counts and times."""
    return public_connections(network).groupBy(
        "remote_ip", "device", "user", F.lower("process_name").alias("image")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def destination_profiles(network: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Per public address: hosts, users, images, connections and windowed reach.

    ``only`` (a frame with ``remote_ip``) restricts the profiles, never the observed span.
    """
    bounds = _bounds(public_connections(network))
    wanted = network if only is None else network.join(only, "remote_ip", "left_semi")
    reduced = destination_hosts(wanted)
    profile = reduced.groupBy("remote_ip").agg(
        F.countDistinct(_full("device")).alias("hosts"), F.countDistinct(_full("user")).alias("users"),
        F.countDistinct(_full("image")).alias("images"), F.sum("n").alias("connections"),
        *_windowed(reduced, "remote_ip", bounds))
    return _prevalence_flags(profile, bounds)


def process_hosts(processes: DataFrame) -> DataFrame:
    """Bridge: ``image, device, signer, sha256, signature_status`` with counts and times."""
    return processes.groupBy(
        F.lower("process_name").alias("image"), "device", "signer", "sha256", "signature_status"
    ).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def process_profiles(processes: DataFrame) -> DataFrame:
    """Per image: hosts, executions, children, signers, hashes, signature states."""
    bounds, reduced = _bounds(processes), process_hosts(processes)
    signer = _full("signer")
    profile = reduced.groupBy("image").agg(
        F.countDistinct(_full("device")).alias("hosts"), F.sum("n").alias("executions"),
        F.countDistinct(signer).alias("signers"), F.min(signer).alias("first_signer"),
        F.countDistinct(_full("sha256")).alias("hashes"),
        F.array_sort(F.collect_set(_full("signature_status"))).alias("signature_states"),
        *_windowed(reduced, "image", bounds))
    children = (
        processes.where(F.coalesce("parent_process_name", F.lit("")) != "")
        .groupBy(F.lower("parent_process_name").alias("image"))
        .agg(F.count(F.lit(1)).alias("spawned_children")))
    joined = profile.join(children, "image", "left").fillna(0, ["spawned_children"])
    return _prevalence_flags(joined, bounds).withColumn(
        "consistently_signed",
        (F.col("signers") == 1) & (F.col("signature_states") == F.array(F.lit("valid"))))


def identity_conflicts(profiles: DataFrame) -> DataFrame:
    """Images whose observations disagree about what they are."""
    odd = F.filter("signature_states", lambda s: s != "valid")
    return profiles.where(
        (F.col("signers") > 1) | ((F.col("signers") > 0) & (F.size(odd) > 0))
    ).select("image", "signers", odd.alias("other_states"))


def security_products(processes: DataFrame) -> DataFrame:
    """Known security images seen, recognised only when consistently signed."""
    spark = processes.sparkSession
    known = spark.createDataFrame(sorted(V.SECURITY_PRODUCTS.items()), "image string, product string")
    seen = processes.where(F.lower("process_name").isin(*V.SECURITY_PRODUCTS))
    return process_profiles(seen).join(known, "image").select(
        "image", "product", F.col("consistently_signed").alias("recognised"))


# ---------------------------------------------------------------- A05-A07


def host_peers(network: DataFrame) -> DataFrame:
    """Bridge: the addresses each host contacted, public or not."""
    pairs = network.where(F.coalesce("remote_ip", F.lit("")) != "").groupBy("device", "remote_ip").agg(
        F.count(F.lit(1)).alias("connections"))
    return pairs.withColumn("is_external", is_public_ip(F.col("remote_ip")))


def interactive_sessions(logons: DataFrame) -> DataFrame:
    """Bridge: accounts with a successful interactive logon on a host."""
    return logons.where(
        (F.col("action") == "success") & F.col("logon_type").isin(*V.INTERACTIVE_LOGON_TYPES)
    ).select("device", "user").distinct()


def remote_sources(logons: DataFrame) -> DataFrame:
    """Bridge: other hosts that authenticated to a host."""
    origin = F.coalesce("source_device", F.lit(""))
    return logons.where(
        (F.col("action") == "success") & F.col("logon_type").isin(*V.REMOTE_LOGON_TYPES)
        & (origin != "") & (origin != F.col("device"))
    ).select("device", "source_device").distinct()


def host_inventory(tel: Telemetry) -> DataFrame:
    """Per host: volumes, sessions, sources, peers and a role inferred from logons."""
    remote = (F.col("action") == "success") & F.col("logon_type").isin(*V.REMOTE_LOGON_TYPES)
    measures = [
        "process_count", "network_count", "logon_count", "remote_logons", "interactive_users",
        "remote_sources", "external_destinations", "internal_peers"]

    def part(df, **aggregates):
        return df.groupBy("device").agg(*[
            aggregates.get(m, F.lit(0)).cast("long").alias(m) for m in measures])

    rows = F.count(F.lit(1))
    parts = [
        part(tel.processes, process_count=rows), part(tel.network, network_count=rows),
        part(tel.logons, logon_count=rows, remote_logons=F.count_if(remote)),
        part(interactive_sessions(tel.logons), interactive_users=rows),
        part(remote_sources(tel.logons), remote_sources=rows),
        part(host_peers(tel.network), external_destinations=F.count_if("is_external"),
             internal_peers=F.count_if(~F.col("is_external"))),
    ]
    hosts = _union(parts).groupBy("device").agg(*[F.sum(m).alias(m) for m in measures])
    users, sources, seen = F.col("interactive_users"), F.col("remote_sources"), F.col("logon_count")
    return hosts.withColumn(
        "role",
        F.when((sources > 0) & (users == 0), "server").when(users > 0, "workstation").otherwise("unknown"),
    ).withColumn(
        "role_reason",
        F.when((sources > 0) & (users == 0), "reached remotely, no interactive logon")
        .when((users > 0) & (sources == 0), "interactive logons only")
        .when(users > 0, "interactive logons and inbound remote ones: could be a jump host")
        .when(seen > 0, "logons carry neither type nor origin")
        .otherwise("no authentication seen"),
    )


def identity_inventory(tel: Telemetry) -> DataFrame:
    """Per account: kind, reach, outcomes and evidence of privileged behaviour."""
    kind = F.col("logon_type")
    auth = tel.logons.groupBy("user", "device").agg(
        F.count_if(F.col("action") == "success").alias("successes"),
        F.count_if(F.col("action") != "success").alias("failures"),
        F.count_if(kind.isin(*V.INTERACTIVE_LOGON_TYPES)).alias("interactive"),
        F.count_if(kind == V.SERVICE_LOGON_TYPE).alias("service"))
    share = F.coalesce("command_line", F.lit("")).rlike(V.ADMIN_SHARE_REFERENCE)
    ran = tel.processes.groupBy("user", "device").agg(F.count_if(share).alias("admin_share_hits"))
    servers = host_inventory(tel).where(F.col("role") == "server").select("device")
    on_servers = interactive_sessions(tel.logons).join(servers, "device", "left_semi")

    measures = ["successes", "failures", "interactive", "service", "admin_share_hits",
                "hosts_authenticated", "hosts_run_on", "server_consoles"]
    zero = lambda **have: [have.get(m, F.lit(0)).cast("long").alias(m) for m in measures]
    col = lambda *names: {n: F.col(n) for n in names}
    users = _union([
        auth.select("user", *zero(hosts_authenticated=F.lit(1), **col("successes", "failures", "interactive", "service"))),
        ran.select("user", *zero(hosts_run_on=F.lit(1), **col("admin_share_hits"))),
        on_servers.select("user", *zero(server_consoles=F.lit(1))),
    ]).groupBy("user").agg(*[F.sum(m).alias(m) for m in measures])
    reach = F.col("hosts_authenticated")
    usual = users.where(reach > 0).agg(F.median("hosts_authenticated").alias("m")).scalar()
    return users.withColumn("median_reach", F.coalesce(usual, F.lit(0.0))).withColumn(
        "kind",
        F.when((F.col("service") > 0) & (F.col("interactive") == 0), "service")
        .when(F.col("interactive") > 0, "interactive").otherwise("unknown"),
    ).withColumn(
        "privilege_signals",
        F.array_compact(F.array(
            F.when(F.col("admin_share_hits") > 0, "admin_share"),
            F.when(F.col("server_consoles") > 0, "server_console"),
            F.when((F.col("median_reach") > 0)
                   & (reach > F.greatest(F.col("median_reach") * 2, F.col("median_reach") + 1)),
                   "distinctive_reach"))),
    )


# ---------------------------------------------------------------- A13


def platforms(tel: Telemetry) -> DataFrame:
    """Every platform the telemetry gives evidence of: ``platform, basis``."""
    image = F.lower("process_name")
    seen = tel.processes.agg(
        F.count_if(image.isin(*V.WINDOWS_MARKER_IMAGES)).alias("markers"),
        F.avg(F.when(image.endswith(".exe"), 1.0).otherwise(0.0)).alias("exe_share"))
    windows = seen.where((F.col("markers") > 0) | (F.col("exe_share") > 0.5)).select(
        F.lit("windows").alias("platform"),
        F.when(F.col("markers") > 0, "system images").otherwise("image names").alias("basis"))

    def from_source(df, source, platform, basis):
        hit = df.agg(F.count_if(F.col("source") == source).alias("n")).where(F.col("n") > 0)
        return hit.select(F.lit(platform).alias("platform"), F.lit(basis).alias("basis"))

    return _union([
        windows, from_source(tel.controls, "cloudtrail_mgmt", "aws", "management rows"),
        from_source(tel.logons, "cloudtrail", "aws", "authentication rows"),
        from_source(tel.controls, "k8s_audit", "kubernetes", "audit rows")])


def data_sources(tel: Telemetry) -> DataFrame:
    return _union([df.select("source").distinct() for df in tel.tables().values()]).where(
        F.coalesce("source", F.lit("")) != "").distinct()


def event_counts(tel: Telemetry) -> DataFrame:
    return _union([tel.table(n).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows")) for n in EVENT_TYPES])
