"""Score expressions: posterior, risk, boosts, ensembles, decision rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe import params


def unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    expr = None
    for name, value in table.items():
        expr = F.when(F.upper(key) == name, F.lit(value)) if expr is None else expr.when(F.upper(key) == name, F.lit(value))
    return expr.otherwise(F.lit(default))


def threshold_multiplier(can_reboot: Column, safety_critical: Column, impact: Column) -> Column:
    return (
        F.when(~F.coalesce(can_reboot, F.lit(True)), F.lit(1.3))
        .when(F.coalesce(safety_critical, F.lit(False)), F.lit(0.7))
        .otherwise(lookup(F.coalesce(impact, F.lit("MEDIUM")), params.IMPACT_MULTIPLIER, 1.0))
    )


def anomaly_gate(score: Column, threshold: Column, mode: str) -> Column:
    """STRUCT<is_anomalous, action_allowed> for an operating mode."""
    if mode not in ("OBSERVE_ONLY", "SUPERVISED_HYBRID", "AUTONOMOUS"):
        raise ValueError(f"unknown mode {mode}")
    flagged = F.lit(False) if mode == "OBSERVE_ONLY" else score >= threshold
    return F.struct(flagged.alias("is_anomalous"), F.lit(mode == "AUTONOMOUS").alias("action_allowed"))


def run_flag(score: Column, action: Column) -> Column:
    act = F.upper(F.coalesce(action, F.lit("")))
    return (F.coalesce(score, F.lit(0.0)) > 0.6) | ~act.isin("MONITOR", "NONE", "")


def risk(likelihood: Column, criticality: Column, internet_facing: Column, confidence: Column, digits: int = 4) -> Column:
    impact = lookup(F.coalesce(criticality, F.lit("MEDIUM")), params.CRITICALITY, 0.5)
    exposure = F.when(F.coalesce(internet_facing, F.lit(False)), F.lit(params.EXPOSURE[True])).otherwise(
        F.lit(params.EXPOSURE[False])
    )
    return F.round(F.least(F.lit(1.0), unit(likelihood) * impact * exposure * unit(confidence)), digits)


def _evidence_likelihood(n: Column) -> Column:
    return F.greatest(n, F.lit(1)) / (F.greatest(n, F.lit(1)) + F.lit(1))


def posterior(supporting: Column, uncertainty: Column, confidence: Column, competitors: Column, digits: int = 4) -> Column:
    """Posterior of the primary against its competitors and a benign null.

    ``competitors`` is ARRAY<STRUCT<confidence, evidence_refs>>.
    """
    own = _evidence_likelihood(F.size(supporting)) * (F.lit(1.0) - unit(uncertainty)) * confidence
    rivals = F.aggregate(
        F.coalesce(competitors, F.array().cast("array<struct<confidence:double,evidence_refs:array<string>>>")),
        F.lit(0.0),
        lambda acc, c: acc + _evidence_likelihood(F.size(c["evidence_refs"])) * F.lit(0.5) * c["confidence"],
    )
    null = F.lit(0.3) * F.greatest(F.lit(0.01), F.lit(1.0) - confidence)
    total = own + rivals + null
    return F.when(total <= 0, confidence).otherwise(F.round(unit(own / total), digits))


def counter_evidence(confidence: Column, checks: dict[str, Column], digits: int = 4) -> Column:
    """Confidence after the penalties of the checks that hold, rounded in order."""
    for name, factor in params.COUNTER_EVIDENCE:
        if name in checks:
            confidence = F.when(checks[name], F.round(confidence * F.lit(factor), digits)).otherwise(confidence)
    return confidence


def safety_gate(world_model: Column, asset: Column) -> Column:
    """True when a human has to decide.

    ``world_model`` is STRUCT<industry, safety_constraints MAP<STRING,BOOLEAN>>
    and ``asset`` a STRUCT that is null for an asset not in the inventory.
    """
    constraint = lambda name: F.coalesce(
        F.try_element_at(world_model["safety_constraints"], F.lit(name)), F.lit(True)
    )
    by_model = (
        ~constraint("can_reboot")
        | ~constraint("auto_isolate_allowed")
        | F.coalesce(world_model["industry"].isin(params.LIFE_SAFETY_INDUSTRIES), F.lit(False))
    )
    by_asset = (
        asset.isNull()
        | ~F.coalesce(asset["can_reboot"], F.lit(True))
        | F.coalesce(asset["safety_critical"], F.lit(False))
    )
    return F.when(world_model.isNotNull(), by_model).otherwise(by_asset)


def decision_rule(
    posterior_: Column, blast: Column, gated: Column, limits: params.DecisionThresholds = params.STANDARD
) -> Column:
    gate = gated if limits.safety_gate else F.lit(False)
    return (
        F.when(gate, "HUMAN_GATE")
        .when(posterior_ <= limits.act_above, "MONITOR")
        .when(blast > limits.blast_limit, "HUMAN_GATE")
        .otherwise("AUTO_RESPOND")
    )


def response_action(decision: Column, chain: Column) -> Column:
    """Action for a decision type, chosen from the technique chain."""
    has = lambda t: F.coalesce(F.array_contains(chain, t), F.lit(False))
    session = has("T1003") | has("T1078")
    held = (
        F.when(has("T1486"), "ISOLATE_HOST").when(session, "REVOKE_SESSION").otherwise("NOTIFY_SOC")
    )
    auto = (
        F.when(has("T1486"), "ISOLATE_HOST")
        .when(has("T1190"), "BLOCK_IP")
        .when(session, "REVOKE_SESSION")
        .otherwise("BLOCK_IP")
    )
    return (
        F.when(decision == "MONITOR", "MONITOR")
        .when(decision == "HUMAN_GATE", F.concat(held, F.lit(" (PENDING HUMAN APPROVAL)")))
        .otherwise(auto)
    )


def critic_gate(action: Column, false_positive: Column) -> Column:
    """A likely false positive never isolates on its own."""
    return F.when((false_positive > 0.5) & (action == "AUTO_RESPOND"), "HUMAN_GATE").otherwise(action)


def decayed(confidence: Column, rate: Column, hours: Column) -> Column:
    """Exponential decay; negative hours are an error."""
    failed = F.raise_error(F.lit("hours since update cannot be negative")).cast("double")
    return F.when(hours < 0, failed).otherwise(confidence * F.exp(-rate * hours))


def hunt_boost(score: Column) -> Column:
    return F.round(F.lit(0.05) + F.lit(0.10) * unit(score), 4)


def federation_boost(matches: Column) -> Column:
    return F.when(matches > 0, F.least(F.lit(0.10) + F.lit(0.05) * (matches - 1), F.lit(0.15))).otherwise(F.lit(0.0))


def boosted(confidence: Column, boost: Column) -> Column:
    return F.round(F.least(confidence + boost, F.lit(1.0)), 4)


def boosted_in_order(confidence: Column, scores: Column) -> Column:
    """Fold the hunt boosts of ARRAY<DOUBLE> scores one after the other."""
    return F.aggregate(scores, confidence, lambda acc, s: boosted(acc, hunt_boost(s)))


def reputation_score(malicious: Column, suspicious: Column, undetected: Column, harmless: Column) -> Column:
    total = malicious + suspicious + undetected + harmless
    return F.when(total > 0, F.round((malicious + suspicious) / total, 4)).otherwise(F.lit(0.0))


def attribution_blend(attribution: Column, genome: Column) -> Column:
    """STRUCT<confidence, uncertainty, move_confidence>."""
    combined = F.round(unit(F.lit(0.6) * attribution + F.lit(0.4) * genome), 3)
    return F.struct(
        combined.alias("confidence"),
        F.round(F.lit(1.0) - combined, 3).alias("uncertainty"),
        F.round(genome * F.lit(0.9), 3).alias("move_confidence"),
    )


def ensemble(isolation: Column, temporal: Column, density: Column, fused: Column, epistemic: Column, org=None) -> Column:
    """STRUCT of the combined score, the uncertainties and the effective confidence."""
    generic = (isolation + density) / 2
    own = temporal if org is None else F.coalesce((temporal + org) / 2, temporal)
    score = F.lit(0.6) * (F.lit(0.4) * generic + F.lit(0.6) * own) + F.lit(0.4) * fused
    parts = [isolation, temporal, density, fused]
    mean = (isolation + temporal + density + fused) / 4
    var = sum(((p - mean) * (p - mean) for p in parts[1:]), (parts[0] - mean) * (parts[0] - mean)) / 4
    aleatoric = F.least(F.sqrt(var) / F.lit(0.5), F.lit(1.0))
    total = F.lit(0.5) * epistemic + F.lit(0.5) * aleatoric
    return F.struct(
        score.alias("anomaly_score"),
        aleatoric.alias("aleatoric"),
        total.alias("uncertainty"),
        ((F.lit(1.0) - total) * score).alias("effective_confidence"),
    )


def boundary_score(margin: Column, scale: Column) -> Column:
    """Sigmoid of the negated margin: outside the boundary scores above one half."""
    return unit(F.lit(1.0) / (F.lit(1.0) + F.exp(margin / scale)))


def primary_goal(goal: Column, confidence: Column, competitors: Column) -> Column:
    """Goal with the highest confidence; a tie keeps the own goal, then the first rival."""
    own = F.struct(confidence.alias("c"), F.lit(0).alias("p"), goal.alias("g"))
    rivals = F.transform(
        competitors, lambda c, i: F.struct(c["confidence"].alias("c"), (-i - 1).cast("int").alias("p"), c["goal"].alias("g"))
    )
    return F.coalesce(F.array_max(F.concat(F.array(own), rivals)), own)["g"]


def fused_graph_score(attention: Column, temporal: Column, neighbour: Column, weights=(0.4, 0.3, 0.3)) -> Column:
    if abs(round(sum(weights), 6) - 1.0) > 1e-4:
        raise ValueError(f"fusion weights must sum to 1, got {sum(weights)}")
    a, t, n = weights
    return F.lit(a) * attention + F.lit(t) * temporal + F.lit(n) * neighbour


def false_positive_rate(precision: Column, recall: Column, total: Column, attacks: Column) -> Column:
    """False-positive rate implied by precision, recall and the class sizes."""
    tp = recall * attacks
    fp = F.when(precision > 0, tp / precision - tp).otherwise(F.lit(0.0))
    return F.when(total - attacks > 0, fp / (total - attacks))
