"""Fusing model scores, rules and threat reports into one risk score per URL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.functions import urls as ur
from baitline.functions.emit import emit_once
from baitline.functions.fixed_values import TRUSTED_DOMAINS
from baitline.functions.text import clip


@dataclass(frozen=True)
class Policy:
    """Weights, floors and cut-offs of one fusion policy."""

    name: str
    url_weight: float = 0.35
    host_weight: float = 0.65
    # model, rule and threat weights, with and without a finished threat report
    with_intel: tuple[float, float, float] = (0.45, 0.40, 0.15)
    without_intel: tuple[float, float] = (0.55, 0.45)
    # a clean rule profile damps the model: (factor, cap); None keeps the weights above
    clean_rules: tuple[float, float] | None = (0.35, 39.0)
    # (signals that must all hold, floor)
    floors: list[tuple[tuple[str, ...], float]] = field(default_factory=list)
    # (lowest host-model probability, floor), strongest first
    host_floors: list[tuple[float, float]] = field(default_factory=list)
    # a fixed floor on model agreement; None applies the evidence-bound treatment
    agreement_floor: float | None = None
    trusted_by: str = "suffix"
    suspicious_from: float = 30.0
    phishing_from: float = 65.0


# Floors of the current policy, of the earlier one, and shared bounds.
CURRENT = Policy(
    name="current",
    floors=[
        (("credentials", "auth_path"), 85), (("credentials",), 80), (("brand", "words"), 75),
        (("brand", "auth_path"), 75), (("brand", "words", "auth_path"), 85), (("tld", "brand"), 80),
        (("tld", "auth_path"), 65), (("ip", "auth_path"), 55), (("encoding", "auth_path"), 60),
    ],
)
EARLIER = Policy(
    name="earlier",
    with_intel=(0.50, 0.35, 0.15),
    without_intel=(0.60, 0.40),
    clean_rules=None,
    floors=[
        (("credentials", "auth_path"), 85), (("credentials",), 80), (("brand", "words"), 80),
        (("brand", "auth_path"), 80), (("tld", "brand"), 80), (("tld", "auth_path"), 65),
        (("ip", "auth_path"), 55), (("encoding", "auth_path"), 60),
    ],
    host_floors=[(0.90, 60), (0.80, 50)],
    agreement_floor=75.0,
    trusted_by="registered_domain",
    suspicious_from=40.0,
    phishing_from=70.0,
)
AGREE_URL = 0.85
AGREE_HOST = 0.75
AGREE_CAP = 69.0
UNSUPPORTED_CAP = 39.0
AGREE_MALICIOUS_FLOOR = 70.0
AGREE_SUSPICIOUS_FLOOR = 60.0
MIN_ENGINES = 10
# (verdict column, lowest count, floor), first match wins
ENGINE_FLOORS = [("malicious", 3, 85.0), ("malicious", 1, 70.0), ("suspicious", 3, 60.0)]
TRUSTED_RULE_BOUND = 30
TRUSTED_CAP = 25.0
TRUSTED_CONFIDENCE = 90.0
LOW_HOST_PROBABILITY = 0.40
STRONG_PROBABILITY = 0.80
SUBSTANTIAL_INTEL = 50

# Which rule signal each floor condition reads. Under "as_wired" only three of the
# names the fusion step asks for exist among the rule signals, so the other four never
# hold; "intended" maps them to the signals they were meant for.
SIGNAL_SOURCES = {
    "as_wired": {"credentials": "has_credentials", "ip": "is_ip_address", "brand": "brand_impersonation"},
    "intended": {
        "credentials": "has_credentials", "ip": "is_ip_address", "brand": "brand_impersonation",
        "auth_path": "suspicious_path_structure", "tld": "suspicious_tld",
        "words": "has_suspicious_words", "encoding": "has_hex_encoding",
    },
}

# Messages of the explanation, in order of appearance.
MSG_INTEL_CLEAN = "Threat intelligence providers did not identify significant malicious activity."
MSG_INTEL_ERROR = "Threat intelligence service was temporarily unavailable; local detection was used."
MSG_INTEL_UNAVAILABLE = "Threat intelligence was unavailable; local ML and security rules were used."
MSG_INTEL_DISABLED = "Threat intelligence lookup was disabled; local ML and security rules were used."
MSG_URL_MODEL = "URL-based ML model detected a strong phishing pattern."
MSG_HOST_MODEL = "Hostname model detected a suspicious hostname pattern."
MSG_MODELS_ALONE = (
    "ML models detected a suspicious pattern, but no independent security evidence "
    "supported a high-risk classification."
)
MSG_TRUSTED = "Recognized trusted registered domain; ML false-positive protection applied."
MSG_INTEL_STRONG = "Threat intelligence indicates substantial malicious activity."


def trusted_host(host: Column, trusted: list[str] | None = None, by: str = "suffix") -> Column:
    """True for a trusted domain or one of its subdomains (or, ``by`` registered domain)."""
    names = trusted or TRUSTED_DOMAINS
    if by == "registered_domain":
        return F.coalesce(ur.registered_domain(host).isin(names), F.lit(False))
    hit = host.isin(names)
    for name in names:
        hit = hit | host.endswith("." + name)
    return F.coalesce(hit, F.lit(False))


def _evidence(df: DataFrame) -> DataFrame:
    """Shared conditions of the fusion steps, as one struct column."""
    success = F.col("intel_status") == "success"
    enough = success & (F.col("total_engines") >= MIN_ENGINES)
    return df.withColumn(
        "_e",
        F.struct(
            F.coalesce(success, F.lit(False)).alias("success"),
            F.coalesce(enough, F.lit(False)).alias("enough"),
            F.coalesce(enough & (F.col("malicious") >= 3), F.lit(False)).alias("strong"),
            F.coalesce(
                enough & ((F.col("malicious") >= 1) | (F.col("suspicious") >= 3)), F.lit(False)
            ).alias("moderate"),
            F.coalesce(
                (F.col("p_url") >= AGREE_URL) & (F.col("p_host") >= AGREE_HOST), F.lit(False)
            ).alias("agree"),
        ),
    )


def model_score(policy: Policy = CURRENT) -> Column:
    url = clip(F.col("p_url") * 100.0, 0.0, 100.0)
    host = clip(F.col("p_host") * 100.0, 0.0, 100.0)
    return F.coalesce(url * policy.url_weight + host * policy.host_weight, host, url, F.lit(0.0))


def fuse_risk(df: DataFrame, policy: Policy = CURRENT, signal_contract: str = "as_wired", prefix: str = "risk") -> DataFrame:
    """Append ``<prefix>_raw``, ``<prefix>_score`` (2 decimals), ``<prefix>_level`` and ``model_score``.

    Input columns: ``host``, ``p_url``, ``p_host`` (nullable), ``rule_score``, ``signals``
    and the threat columns. Every step is a projection over the running score.
    """
    sources = SIGNAL_SOURCES[signal_contract]
    rule = F.coalesce(F.col("rule_score"), F.lit(0)).cast("double")
    intel = F.coalesce(F.col("intel_score"), F.lit(0.0))

    def step(frame: DataFrame, value: Column) -> DataFrame:
        return frame.withColumn("_risk", value)

    def signal(name: str) -> Column:
        if name not in sources:
            return F.lit(False)
        return F.coalesce(F.col(f"signals.{sources[name]}"), F.lit(False))

    out = _evidence(df).withColumns({
        "model_score": model_score(policy),
        "_trusted": trusted_host(F.col("host"), by=policy.trusted_by),
    })
    model, risk = F.col("model_score"), F.col("_risk")

    m, r, t = policy.with_intel
    weighted = F.when(F.col("_e.success"), model * m + rule * r + intel * t).otherwise(
        model * policy.without_intel[0] + rule * policy.without_intel[1]
    )
    if policy.clean_rules:
        factor, cap = policy.clean_rules
        weighted = F.when(rule <= 0, F.least(model * factor, F.lit(cap))).otherwise(weighted)
    out = step(out, F.greatest(weighted, rule))

    floors = []
    for names, floor in policy.floors:
        if all(n in sources for n in names):
            holds = signal(names[0])
            for n in names[1:]:
                holds = holds & signal(n)
            floors.append(F.when(holds, F.lit(float(floor))))
    if policy.host_floors:
        by_host = F.when(F.lit(False), F.lit(0.0))
        for bound, floor in policy.host_floors:
            by_host = by_host.when(F.col("p_host") >= bound, F.lit(float(floor)))
        floors.append(by_host)
    out = step(out, F.greatest(risk, F.lit(0.0), *floors))

    if policy.agreement_floor is not None:
        agreed = F.greatest(risk, F.lit(policy.agreement_floor))
    else:
        agreed = (
            F.when(rule > 0, F.greatest(risk, F.least(F.lit(AGREE_CAP), model * 0.65 + rule * 0.35)))
            .when(F.col("_e.success") & (F.col("malicious") > 0), F.greatest(risk, F.lit(AGREE_MALICIOUS_FLOOR)))
            .when(F.col("_e.success") & (F.col("suspicious") > 0), F.greatest(risk, F.lit(AGREE_SUSPICIOUS_FLOOR)))
            .otherwise(F.least(risk, F.lit(UNSUPPORTED_CAP)))
        )
    out = step(out, F.when(F.col("_e.agree"), agreed).otherwise(risk))

    engine_floor = F.when(~F.col("_e.enough"), F.lit(0.0))
    for verdict, bound, floor in ENGINE_FLOORS:
        engine_floor = engine_floor.when(F.col(verdict) >= bound, F.lit(floor))
    out = step(out, F.greatest(risk, engine_floor))

    protected = F.col("_trusted") & (rule < TRUSTED_RULE_BOUND) & ~F.col("_e.strong")
    out = out.withColumn("_protected", protected)
    quiet = (rule == 0) & (F.col("p_host") < LOW_HOST_PROBABILITY)
    out = step(
        out,
        F.when(F.col("_protected"), F.least(risk, F.lit(TRUSTED_CAP)))
        .when(quiet, F.least(risk, F.lit(UNSUPPORTED_CAP)))
        .otherwise(risk),
    )
    out = step(out, clip(risk, 0.0, 100.0))
    level = F.when(risk >= policy.phishing_from, "PHISHING").when(risk >= policy.suspicious_from, "SUSPICIOUS")
    made = {
        "model_score": model,
        f"{prefix}_raw": risk,
        f"{prefix}_score": F.round(risk, 2),
        f"{prefix}_level": level.otherwise("SAFE"),
        "trusted_domain": F.col("_trusted"),
        "trusted_protection": F.col("_protected"),
    }
    return emit_once(out, [c for c in df.columns if c not in made], made)


def confidence(df: DataFrame, prefix: str = "risk") -> DataFrame:
    """Append ``confidence`` (0-100, 2 decimals) and its unrounded value."""
    rule = F.coalesce(F.col("rule_score"), F.lit(0)).cast("double")
    terms = [
        F.abs(F.col("p_url") - 0.5) * 2,
        F.abs(F.col("p_host") - 0.5) * 2,
        F.when(rule > 0, rule / 100.0),
        F.when(
            (F.col("intel_status") == "success") & (F.col("total_engines") > 0),
            clip(F.col("intel_score") / 100.0, 0.0, 1.0),
        ),
    ]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0)))
    n = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in terms[1:]), F.when(terms[0].isNotNull(), 1).otherwise(0))
    out = df.withColumns({"_total": total, "_n": n})
    mean = F.when(F.col("_n") > 0, F.col("_total") / F.nullif(F.col("_n"), F.lit(0)) * 100.0).otherwise(
        F.abs(F.col(f"{prefix}_raw") - 50.0) * 2
    )
    lifted = F.when(F.col("trusted_protection"), F.greatest(mean, F.lit(TRUSTED_CONFIDENCE))).otherwise(mean)
    out = out.withColumn("confidence_raw", clip(lifted, 0.0, 100.0))
    return out.withColumn("confidence", F.round("confidence_raw", 2)).drop("_total", "_n")


def dedup_reasons(reasons: Column) -> Column:
    """Order-preserving unique messages."""
    return F.array_distinct(reasons)


def explain(df: DataFrame, prefix: str = "risk") -> DataFrame:
    """Append ``reasons``: ordered, de-duplicated messages behind the verdict."""
    rule = F.coalesce(F.col("rule_score"), F.lit(0))
    status, level = F.col("intel_status"), F.col(f"{prefix}_level")
    base = _evidence(df)
    success = F.col("_e.success")
    detected = (F.col("malicious") > 0) | (F.col("suspicious") > 0)
    raised = level.isin("SUSPICIOUS", "PHISHING")
    local = F.array_compact(
        F.array(
            F.when(success & ~detected & (F.col("total_engines") > 0), F.lit(MSG_INTEL_CLEAN))
            .when(status == "error", F.lit(MSG_INTEL_ERROR))
            .when(status == "unavailable", F.lit(MSG_INTEL_UNAVAILABLE))
            .when(status == "disabled", F.lit(MSG_INTEL_DISABLED)),
            F.when(raised & (F.col("p_url") >= STRONG_PROBABILITY), F.lit(MSG_URL_MODEL)),
            F.when(raised & (F.col("p_host") >= STRONG_PROBABILITY), F.lit(MSG_HOST_MODEL)),
            F.when(
                (level == "SAFE") & F.col("_e.agree") & (rule == 0) & ~F.col("_e.moderate"),
                F.lit(MSG_MODELS_ALONE),
            ),
            F.when(F.col("trusted_protection"), F.lit(MSG_TRUSTED)),
            F.when(success & (F.col("intel_score") >= SUBSTANTIAL_INTEL), F.lit(MSG_INTEL_STRONG)),
        )
    )
    nothing = F.array().cast("array<string>")
    reported = F.when(success & detected, F.col("intel_reasons")).otherwise(nothing)
    joined = F.concat(F.coalesce(F.col("rule_reasons"), nothing), F.coalesce(reported, nothing), local)
    return base.withColumn("reasons", dedup_reasons(joined)).drop("_e")


def assess(df: DataFrame, policy: Policy = CURRENT, signal_contract: str = "as_wired") -> DataFrame:
    """Score, level, confidence and reasons in one go."""
    return explain(confidence(fuse_risk(df, policy, signal_contract)))


def policy_backtest(
    df: DataFrame, before: Policy = EARLIER, after: Policy = CURRENT, signal_contract: str = "as_wired"
) -> DataFrame:
    """How levels move between two policies: one row per (level before, level after)."""
    both = fuse_risk(df, before, signal_contract, prefix="before").drop(
        "model_score", "trusted_domain", "trusted_protection"
    )
    both = fuse_risk(both, after, signal_contract, prefix="after")
    return both.groupBy("before_level", "after_level").agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.avg(F.col("after_raw") - F.col("before_raw")).alias("mean_shift"),
    )


#: What the text of a scan response reads as.
RESPONSE_SCHEMA = (
    "success boolean, url string, risk struct<score: double, level: string, confidence: double>, prediction string, trusted_domain boolean, "
    "reasons array<string>, models struct<url_ml: {m}, hostname_ml: {m}, fusion_score: double, rule_score: double>, "
    "threat_intelligence struct<provider: string, status: string, malicious: int, suspicious: int, harmless: int, undetected: int, "
    "total_engines: int, threat_score: double, reasons: array<string>>, scan_duration_ms double, cache struct<hit: boolean, source: string>"
).format(m="struct<available: boolean, prediction: int, probability: double, score: double>")


def serialize_scan(df: DataFrame, prefix: str = "risk") -> DataFrame:
    """The nested scan response as JSON text, next to its URL.

    Expects an assessed table; ``cache_hit`` and ``scan_duration_ms`` are used when
    present.
    """
    def optional(name: str, default: Column) -> Column:
        return F.col(name) if name in df.columns else default

    def model(probability: str) -> Column:
        p = F.col(probability)
        return F.struct(
            p.isNotNull().alias("available"),
            F.when(p.isNotNull(), (p > 0.5).cast("int")).alias("prediction"),
            p.alias("probability"),
            (p * 100.0).alias("score"),
        )

    hit = optional("cache_hit", F.lit(False))
    response = F.struct(
        F.lit(True).alias("success"),
        F.col("normalized_url").alias("url"),
        F.struct(
            F.col(f"{prefix}_score").alias("score"),
            F.col(f"{prefix}_level").alias("level"),
            F.col("confidence"),
        ).alias("risk"),
        F.col(f"{prefix}_level").alias("prediction"),
        F.col("trusted_domain"),
        dedup_reasons(F.col("reasons")).alias("reasons"),
        F.struct(
            model("p_url").alias("url_ml"),
            model("p_host").alias("hostname_ml"),
            F.round("model_score", 2).alias("fusion_score"),
            F.col("rule_score").cast("double").alias("rule_score"),
        ).alias("models"),
        F.struct(
            F.col("intel_provider").alias("provider"),
            F.col("intel_status").alias("status"),
            "malicious", "suspicious", "harmless", "undetected", "total_engines",
            F.col("intel_score").alias("threat_score"),
            F.col("intel_reasons").alias("reasons"),
        ).alias("threat_intelligence"),
        F.when(hit, F.lit(0.0)).otherwise(optional("scan_duration_ms", F.lit(None).cast("double"))).alias(
            "scan_duration_ms"
        ),
        F.struct(
            hit.alias("hit"),
            F.when(hit, F.lit("cache")).otherwise(F.lit("risk_engine")).alias("source"),
        ).alias("cache"),
    )
    return df.select(F.col("normalized_url").alias("url"), F.to_json(response).alias("response"))
