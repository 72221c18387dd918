"""Policy decisions, row filtering and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracework.functions.ids import uuid3


#: What owners and listed parties may ask for, and what only owners may.
SHARED, OWNERS = ("read", "write", "update"), ("delete", "admin")
#: Reasons that grant.
GRANTED = ("public", "owner", "authorized")


def decide(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """A decision with its reason for every request, by the policy of its resource (none: ``no-policy``)."""
    p = policies.withColumn("policy_resource_id", F.col("resource_id"))
    return decide_pairs(requests.join(p, "resource_id", "left").withColumn("_asked", F.struct(*requests.columns))).select("_asked.*", "success", "reason", "reason_strict")


def decide_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` of a request and a policy (its resource as ``policy_resource_id``) with ``success``, ``reason`` and ``reason_strict``.

    Owners may do anything, listed parties read, write and update; other actions
    are nobody's. Visibility is looked at first: a public policy asks for an allowed
    action only, a private one for its owner, a restricted one for a time within the
    window (open at both ends, owners too), then for an owner or a listed party,
    then for an allowed action. ``reason`` of a time outside the window is
    ``not-yet-valid`` where the policy has a start, else ``expired``;
    ``reason_strict`` tells the two apart by the time.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    owner = known(F.col("requestor_id") == F.col("owner_id"))
    listed = owner | known(F.array_contains("authorized_parties", F.col("requestor_id")))
    action = F.col("requested_action")
    allowed = known((action.isin(*OWNERS) & owner) | (action.isin(*SHARED) & listed))
    early = F.col("valid_from").isNotNull() & ~known(F.col("request_time") > F.col("valid_from"))
    late = F.col("valid_until").isNotNull() & ~known(F.col("request_time") < F.col("valid_until"))
    refused = F.lit("action-not-allowed")
    restricted = (
        F.when((early | late) & F.col("valid_from").isNotNull(), "not-yet-valid")
        .when(early | late, "expired")
        .when(~listed, "not-authorized")
        .otherwise(F.when(allowed, "authorized").otherwise(refused))
    )
    reason = (
        F.when(F.col("policy_resource_id").isNull(), "no-policy")
        .when(~known(F.col("policy_resource_id") == F.col("resource_id")), "resource-mismatch")
        .when(F.col("visibility") == "public", F.when(allowed, "public").otherwise(refused))
        .when(F.col("visibility") == "private", F.when(~owner, "not-authorized").otherwise(F.when(allowed, "owner").otherwise(refused)))
        .when(F.col("visibility") == "restricted", restricted)
        .otherwise("invalid-visibility")
    )
    strict = F.when((reason == "not-yet-valid") & ~early, "expired").otherwise(reason)
    return pairs.withColumns({"success": reason.isin(*GRANTED), "reason": reason, "reason_strict": strict})


def accessible(policies: DataFrame, request: dict) -> DataFrame:
    """Policies whose resource one request (requestor, action, time; a resource if it names one) may use."""
    asked = {"requestor_id": request["requestor_id"], "requested_action": request["requested_action"], "request_time": request["request_time"]}
    resource = F.lit(request["resource_id"]) if "resource_id" in request else F.col("resource_id")
    pairs = policies.withColumns({"_policy": F.struct(*policies.columns), "policy_resource_id": F.col("resource_id"), "resource_id": resource})
    return decide_pairs(pairs.withColumns({k: F.lit(v) for k, v in asked.items()})).where("success").select("_policy.*")


def with_permissions(rows: DataFrame, key: str, decisions: DataFrame, requestor) -> DataFrame:
    """Rows whose resource the requestor was granted."""
    ok = decisions.where((F.col("requestor_id") == requestor) & F.col("success")).select(F.col("resource_id").alias(key)).distinct()
    return rows.join(ok, key, "left_semi")


def authorise_batches(decisions: DataFrame, batch: str) -> DataFrame:
    """A batch passes if all its resources do; the denied ones are counted."""
    return decisions.groupBy(batch).agg(
        F.bool_and("success").alias("authorized"), F.count_if(~F.col("success")).alias("denied"), F.count(F.lit(1)).alias("resources")
    )


def audit(decisions: DataFrame) -> DataFrame:
    """Audit rows with stable identifiers."""
    key = F.concat_ws("/", F.lit("audit"), "requestor_id", "resource_id", "requested_action", F.date_format("request_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return decisions.select(
        uuid3(key).alias("audit_id"), F.col("requestor_id").alias("actor"), "resource_id", "requested_action",
        F.when(F.col("success"), "granted").otherwise("denied").alias("outcome"), "reason", "request_time",
    )


def access_statistics(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("requested_action").agg(F.count_if("success").alias("granted"), F.count_if(~F.col("success")).alias("denied"))


def policy_statistics(policies: DataFrame) -> DataFrame:
    """``visibility, policies``: how many policies there are of each visibility."""
    return policies.groupBy("visibility").agg(F.count(F.lit(1)).alias("policies"))


def by_roles(requests: DataFrame, roles: DataFrame, allowed: DataFrame, policies: DataFrame) -> DataFrame:
    """Role decisions: ``roles`` (requestor_id, role), ``allowed`` (role, requested_action).

    The union of a requestor's roles counts; owners of a resource need no role.
    """
    ok = roles.join(allowed, "role").select("requestor_id", "requested_action").distinct().withColumn("ok", F.lit(True))
    own = policies.select("resource_id", F.col("owner_id").alias("requestor_id")).distinct().withColumn("own", F.lit(True))
    success = F.coalesce("own", "ok", F.lit(False))
    return requests.join(ok, ["requestor_id", "requested_action"], "left").join(own, ["resource_id", "requestor_id"], "left").select(
        *(requests[c] for c in requests.columns), success.alias("success"), F.when(success, "role-authorized").otherwise("role-not-authorized").alias("reason")
    )


def granters_by_roles(roles: DataFrame) -> DataFrame:
    """Requestors whose roles let them grant and revoke."""
    return roles.where(F.col("role").isin("admin", "owner")).select("requestor_id").distinct()


def change_policies(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """Policies after changes ``resource_id, seq, op`` with ``party``, ``visibility``, ``valid_from`` and ``valid_until``.

    ``op`` is grant, revoke, visibility or time. For each party of a resource the
    last grant or revocation by ``seq`` counts; so does the last change of
    visibility and of times. Changes of unknown resources are left out. Parties
    come out sorted, each once.
    """
    last = changes.where("op in ('grant', 'revoke')").groupBy("resource_id", "party").agg(F.max_by("op", "seq").alias("op"))
    named = lambda op: F.collect_set(F.when(F.col("op") == op, F.col("party")))
    parties = last.groupBy("resource_id").agg(named("grant").alias("more"), named("revoke").alias("less"))
    at = lambda op, value: F.max(F.when(F.col("op") == op, F.struct("seq", value)))
    other = changes.groupBy("resource_id").agg(
        at("visibility", F.col("visibility").alias("x")).alias("v"), at("time", F.struct("valid_from", "valid_until").alias("x")).alias("t")
    )
    out = policies.join(parties, "resource_id", "left").join(other, "resource_id", "left")
    none = F.expr("slice(authorized_parties, 1, 0)")
    now = F.array_except(F.array_union("authorized_parties", F.coalesce("more", none)), F.coalesce("less", none))
    new = {
        "authorized_parties": F.array_sort(now),
        "visibility": F.coalesce("v.x", policies["visibility"]) if "visibility" in policies.columns else None,
        "valid_from": F.when(F.col("t").isNotNull(), F.col("t.x.valid_from")).otherwise(policies["valid_from"]) if "valid_from" in policies.columns else None,
        "valid_until": F.when(F.col("t").isNotNull(), F.col("t.x.valid_until")).otherwise(policies["valid_until"]) if "valid_until" in policies.columns else None,
    }
    return out.select(*(new[c].alias(c) if new.get(c) is not None else policies[c] for c in policies.columns))


def grant(policies: DataFrame, changes: DataFrame) -> DataFrame:
    """Policies after a batch of grants and revocations ``resource_id, party, op``, in order of ``seq`` if given; else revocations come last."""
    seq = F.col("seq") if "seq" in changes.columns else F.when(F.col("op") == "revoke", 1).otherwise(0)
    null = F.lit(None)
    return change_policies(policies, changes.select("resource_id", "party", "op", seq.alias("seq"), null.cast("string").alias("visibility"), null.cast("timestamp").alias("valid_from"), null.cast("timestamp").alias("valid_until")))


def decide_by(strategy, requests: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """Decisions of any strategy: a function of requests and rules that adds ``success`` and, if it likes, ``reason``."""
    made = strategy(requests, rules)
    reason = F.col("reason") if "reason" in made.columns else F.when(F.col("success"), f"{name}-authorized").otherwise(f"{name}-not-authorized")
    return made.select(*requests.columns, F.coalesce("success", F.lit(False)).alias("success"), reason.alias("reason"))


def owners_only(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """A strategy: owners may do anything, others nothing."""
    own = policies.select("resource_id", F.col("owner_id").alias("requestor_id"), F.lit(True).alias("own"))
    return requests.join(own, ["resource_id", "requestor_id"], "left").select(*requests.columns, F.coalesce("own", F.lit(False)).alias("success"))


#: The fields that digests of policies and requests cover, and the version of proofs.
POLICY_FIELDS = ("authorized_parties", "owner_id", "permission_id", "resource_id", "resource_type", "valid_from", "valid_until", "visibility")
REQUEST_FIELDS = ("request_context", "request_time", "requested_action", "requestor_id", "resource_id")
PROOF_VERSION = 1


def _json(rows: DataFrame, names: tuple[str, ...]):
    """Sorted-key JSON of the given fields that ``rows`` has; times as UTC text, parties sorted, nulls left out."""
    def shown(c: str):
        if rows.schema[c].dataType.typeName().startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
        return F.array_sort(c).alias(c) if c == "authorized_parties" else F.col(c)

    return F.to_json(F.struct(*(shown(c) for c in names if c in rows.columns)))


def policy_digest(policies: DataFrame) -> DataFrame:
    """``resource_id, policy_hash``: the digest of each policy as sorted-key JSON of ``POLICY_FIELDS``."""
    return policies.select("resource_id", F.sha2(_json(policies, POLICY_FIELDS), 256).alias("policy_hash"))


def proof(decisions: DataFrame, policies: DataFrame) -> DataFrame:
    """Decision proofs: digests of policy (null without one) and request, and of the payload that holds both with decision and reason."""
    rows = decisions.withColumn("request_hash", F.sha2(_json(decisions, REQUEST_FIELDS), 256)).join(policy_digest(policies), "resource_id", "left")
    payload = F.struct(
        F.col("requested_action").alias("action"), F.when(F.col("success"), "allow").otherwise("deny").alias("decision"), "policy_hash", "reason", "request_hash",
        "requestor_id", "resource_id", F.date_format("request_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit(PROOF_VERSION).alias("version"),
    )
    return rows.select("request_id", "policy_hash", "request_hash", F.sha2(F.to_json(payload), 256).alias("proof_hash"))


#: The domains of policies and requests.
VISIBILITIES, ACTIONS = ("public", "restricted", "private"), ("read", "write", "update", "delete", "admin")


def by_attributes(requests: DataFrame, rules: dict) -> DataFrame:
    """Attribute decisions: action, department and location must be equal, level at least as given; other rules pass."""
    ok = F.lit(True)
    for key, value in rules.items():
        if key in ("action", "department", "location"):
            ok = ok & F.coalesce(F.col("requested_action" if key == "action" else key) == value, F.lit(False))
        elif key == "level":
            ok = ok & F.coalesce(F.col("level") >= value, F.lit(False))
    return requests.withColumns({"success": ok, "reason": F.when(ok, "attribute-authorized").otherwise("attribute-not-authorized")})


def current_policies(log: DataFrame, order: str) -> DataFrame:
    """The last entry of each resource in a log of policies with ``op`` put or remove; removed ones go."""
    last = log.groupBy("resource_id").agg(F.max_by(F.struct(*(c for c in log.columns if c != "resource_id")), order).alias("p"))
    return last.select("resource_id", "p.*").where("op != 'remove'").drop("op")


def verify_proof(proofs: DataFrame, decisions: DataFrame, policies: DataFrame) -> DataFrame:
    """``request_id, valid``: whether all digests are those of the decision, its request and its policy."""
    again = proof(decisions, policies).toDF("request_id", "o", "r", "p")
    same = F.col("o").eqNullSafe(F.col("policy_hash")) & (F.col("r") == F.col("request_hash")) & (F.col("p") == F.col("proof_hash"))
    return proofs.join(again, "request_id", "left").select("request_id", F.coalesce(same, F.lit(False)).alias("valid"))


def request_faults(requests: DataFrame) -> DataFrame:
    """``request_id, faults``: what keeps a request from being well formed, in order."""
    need = ("requestor_id", "resource_id", "requested_action", "request_time")
    bad = F.array_compact(F.array(
        *(F.when(F.col(c).isNull(), f"missing {c}") for c in need),
        F.when(~F.col("requested_action").isin(*ACTIONS), "unknown action"),
    ))
    return requests.select("request_id", F.array_join(bad, "; ").alias("faults"))


def policy_faults(policies: DataFrame) -> DataFrame:
    """``resource_id, faults``: what keeps a policy from being well formed, in order."""
    need = ("owner_id", "visibility")
    late = F.col("valid_from").isNotNull() & F.col("valid_until").isNotNull() & (F.col("valid_from") > F.col("valid_until"))
    bad = F.array_compact(F.array(
        *(F.when(F.col(c).isNull(), f"missing {c}") for c in need),
        F.when(~F.col("visibility").isin(*VISIBILITIES), "unknown visibility"),
        F.when(late, "ends before it starts"),
    ))
    return policies.select("resource_id", F.array_join(bad, "; ").alias("faults"))
