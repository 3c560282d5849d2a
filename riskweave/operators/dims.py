"""Static dimensions: taxonomy, controls, severities, profiles, remediation agents.

Fixed values: the codes, names, weights, bands and texts below are reference data that results depend on; they are small
constant tables, so joins with them broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OWASP = {
    "LLM01": "Prompt Injection",
    "LLM02": "Sensitive Information Disclosure",
    "LLM03": "Supply Chain",
    "LLM04": "Data and Model Poisoning",
    "LLM05": "Improper Output Handling",
    "LLM06": "Excessive Agency",
    "LLM07": "System Prompt Leakage",
    "LLM08": "Vector and Embedding Weaknesses",
    "LLM09": "Misinformation",
    "LLM10": "Unbounded Consumption",
}
ATLAS = {
    "AML.T0051": "LLM Prompt Injection",
    "AML.T0051.000": "LLM Prompt Injection: Direct",
    "AML.T0051.001": "LLM Prompt Injection: Indirect",
    "AML.T0053": "LLM Plugin Compromise",
    "AML.T0055": "Unsecured Credentials",
    "AML.T0010": "ML Supply Chain Compromise",
    "AML.T0018": "Manipulate AI Model (Poisoning)",
    "AML.T0020": "Poison Training Data",
    "AML.T0016": "Obtain Capabilities",
}
CONTROLS = {
    "EU_AI_ACT": {"Art.9": "Risk management system", "Art.10": "Data and data governance", "Art.12": "Record-keeping and logging", "Art.14": "Human oversight", "Art.15": "Accuracy, robustness and cybersecurity of high-risk AI systems"},
    "NIST_AI_RMF": {"MANAGE-2.1": "Resources to manage AI risks are allocated", "MAP-5.1": "Likelihood and impact of risks are determined", "MEASURE-2.7": "AI system security and resilience are evaluated"},
    "ISO_42001": {"A.6.2.4": "AI system verification and validation", "A.8.2": "AI system impact assessment"},
    "ISO_27001": {"A.8.24": "Use of cryptography / secrets management", "A.8.25": "Secure development life cycle", "A.8.28": "Secure coding", "A.5.23": "Information security for use of cloud/AI services"},
    "NIST_CSF": {"PR.DS": "Data security (protect)", "PR.PS": "Platform security / secure configuration (protect)", "DE.CM": "Continuous monitoring (detect)", "ID.RA": "Risk assessment (identify)"},
    "SOC2": {"CC6.1": "Logical access security", "CC7.1": "Detection of security events", "CC8.1": "Change management"},
}
OWASP_CONTROLS = {
    "LLM01": ["EU_AI_ACT Art.15", "EU_AI_ACT Art.14", "NIST_AI_RMF MEASURE-2.7", "ISO_42001 A.6.2.4", "ISO_27001 A.8.28", "NIST_CSF PR.PS"],
    "LLM02": ["EU_AI_ACT Art.10", "SOC2 CC6.1", "NIST_AI_RMF MAP-5.1", "ISO_27001 A.8.24", "NIST_CSF PR.DS"],
    "LLM03": ["EU_AI_ACT Art.15", "ISO_42001 A.8.2", "NIST_AI_RMF MANAGE-2.1", "ISO_27001 A.8.25", "SOC2 CC8.1", "NIST_CSF ID.RA"],
    "LLM04": ["EU_AI_ACT Art.10", "NIST_AI_RMF MAP-5.1", "NIST_CSF PR.DS"],
    "LLM05": ["EU_AI_ACT Art.15", "SOC2 CC7.1", "ISO_27001 A.8.28", "NIST_CSF PR.PS"],
    "LLM06": ["EU_AI_ACT Art.9", "EU_AI_ACT Art.14", "NIST_AI_RMF MANAGE-2.1", "ISO_42001 A.8.2", "NIST_CSF PR.PS"],
    "LLM07": ["SOC2 CC6.1", "NIST_AI_RMF MEASURE-2.7", "ISO_27001 A.8.24"],
    "LLM08": ["EU_AI_ACT Art.10", "ISO_42001 A.6.2.4", "NIST_CSF PR.DS"],
    "LLM09": ["NIST_AI_RMF MAP-5.1", "EU_AI_ACT Art.14"],
    "LLM10": ["EU_AI_ACT Art.15", "EU_AI_ACT Art.12", "SOC2 CC7.1", "NIST_CSF DE.CM", "ISO_27001 A.5.23"],
}
CONSEQUENCE = {
    "LLM01": "Attacker steers the model to bypass policy, exfiltrate data, or misuse tools.",
    "LLM02": "Customer or proprietary data leaks; regulatory + breach-notification exposure.",
    "LLM03": "Compromised dependency/model executes attacker code inside your trust boundary.",
    "LLM04": "Poisoned data degrades model integrity and decisions at scale.",
    "LLM05": "Unsafe model output drives downstream systems (XSS, SQLi, RCE).",
    "LLM06": "Agent takes real-world actions attacker directs — financial/operational loss.",
    "LLM07": "System prompt / secrets leak, exposing IP and enabling targeted attacks.",
    "LLM08": "Retrieval corpus manipulation returns attacker-controlled context.",
    "LLM09": "Model emits confidently wrong output — liability, reputational, safety risk.",
    "LLM10": "Uncapped consumption enables cost-blowout / denial-of-wallet.",
}
#: name, value, weight in the score, yearly loss low and high (USD), report level, security severity
SEVERITIES = [
    ("CRITICAL", 5, 40.0, 250_000, 5_000_000, "error", "9.5"),
    ("HIGH", 4, 20.0, 50_000, 750_000, "error", "8.0"),
    ("MEDIUM", 3, 8.0, 10_000, 100_000, "warning", "5.5"),
    ("LOW", 2, 3.0, 1_000, 20_000, "note", "3.0"),
    ("INFO", 1, 0.5, 0, 2_000, "note", "1.0"),
]
DECAY = 0.6
GRADES = [(90, "A"), (75, "B"), (60, "C"), (40, "D")]
#: profile, lowest severity shown, shows findings, evidence, remediation, business, compliance
PROFILES = [
    ("engineer", 2, True, True, True, False, False),
    ("appsec", 2, True, True, True, True, False),
    ("ciso", 3, False, False, False, True, True),
    ("product", 3, True, False, True, True, True),
]
#: detector, agent, name, may act by itself
AGENTS = [
    ("prompt-hardening", "prompt-boundary", "Prompt Boundary Agent", True),
    ("secrets", "secret-rotation", "Secret Rotation Agent", False),
    ("unsafe-model-load", "safe-loader", "Safe Loader Agent", True),
    ("output-handling", "output-sanitizer", "Output Sanitizer Agent", True),
    ("tool-exposure", "agency-gate", "Agency Gate Agent", True),
    ("unbounded-consumption", "rate-limiter", "Rate Limiter Agent", True),
    ("rag-trust", "provenance", "Provenance Agent", False),
]
FALLBACK_AGENT = ("review", "Manual Review Agent", False)


def owasp(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, CONSEQUENCE[k]) for k, v in OWASP.items()], "owasp_llm string, owasp_name string, consequence string")


def atlas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ATLAS.items()), "technique string, technique_name string")


def severities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEVERITIES, "severity string, sev_value int, weight double, ale_low long, ale_high long, level string, security_severity string")


def owasp_controls(spark: SparkSession) -> DataFrame:
    rows = [(k, *x.split(" ", 1)) for k, v in OWASP_CONTROLS.items() for x in v]
    return spark.createDataFrame(rows, "owasp_llm string, framework string, control string")


def controls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, c, t) for f, x in CONTROLS.items() for c, t in x.items()], "framework string, control string, description string")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile string, floor int, findings boolean, evidence boolean, remediation boolean, business boolean, compliance boolean")


def agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AGENTS, "detector string, agent_id string, agent_name string, auto_available boolean")


def sql_values(rows: list[tuple], *names: str) -> str:
    """A VALUES list for SQL, of plain numbers, booleans and strings."""
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ") as v(" + ", ".join(names) + ")"
