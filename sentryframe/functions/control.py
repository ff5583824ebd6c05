"""Column functions over control-plane rows: verb classes, services, authority, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V


def _clean(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def verb_class(verb: Column) -> Column:
    """One of eight classes; a verb in no list is ``other``."""
    token = _clean(verb)
    out = F.lit("other")
    for name, verbs in V.VERBS_BY_CLASS.items():
        out = F.when(token.isin(*verbs), F.lit(name)).otherwise(out)
    return out


def service_of(resource_type: Column) -> Column:
    return F.substring_index(_clean(resource_type), ":", 1)


def _identity_object(resource_type: Column) -> Column:
    return service_of(resource_type).isin(*V.IDENTITY_SERVICES) | _clean(resource_type).isin(
        *V.RBAC_BINDING_RESOURCES
    )


def changes_authority(verb: Column, resource_type: Column) -> Column:
    return verb_class(verb).isin(*V.AUTHORITY_CHANGING_CLASSES) & _identity_object(resource_type)


def is_grant(verb: Column, resource_type: Column) -> Column:
    return (verb_class(verb) == "grant") | (
        (_clean(verb) == "create") & _clean(resource_type).isin(*V.RBAC_BINDING_RESOURCES)
    )


def is_identity_grant(verb: Column, resource_type: Column) -> Column:
    return _identity_object(resource_type) & (
        is_grant(verb, resource_type) | (verb_class(verb) == "revoke")
    )


def classify_decision(code: Column, http_status: Column | None = None) -> Column:
    """allowed / denied / failed from an error code and an optional HTTP status."""
    text = _clean(code)
    status = http_status if http_status is not None else F.lit(None).cast("int")
    ok = status.isNull() | status.between(200, 299) | (status == V.PROTOCOL_UPGRADE_STATUS)
    return (
        F.when(text.rlike("|".join(V.AUTHORIZATION_ERROR_TOKENS)), V.DENIED)
        .when(F.coalesce(status.isin(*V.AUTHORIZATION_HTTP_STATUSES), F.lit(False)), V.DENIED)
        .when(text != "", V.FAILED)
        .when(ok, V.ALLOWED)
        .otherwise(V.FAILED)
    )


def with_control_classes(controls):
    """Add the derived columns several rules share."""
    verb, resource = F.col("verb"), F.col("resource_type")
    return (
        controls.withColumn("verb_class", verb_class(verb))
        .withColumn("service", service_of(resource))
        .withColumn("identity_service", F.col("service").isin(*V.IDENTITY_SERVICES))
        .withColumn(
            "changes_authority",
            F.col("verb_class").isin(*V.AUTHORITY_CHANGING_CLASSES)
            & (F.col("identity_service") | _clean(resource).isin(*V.RBAC_BINDING_RESOURCES)),
        )
    )
