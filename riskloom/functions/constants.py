"""Fixed values of the risk model: states, matrices, weights, thresholds and lookup tables."""

STATES = ("Unknown", "Disclosed", "ExploitAvailable", "ActivelyExploited", "Mitigated", "Remediated")

BASE_TPM = (
    (0.80, 0.15, 0.03, 0.01, 0.01, 0.00),
    (0.00, 0.70, 0.15, 0.05, 0.05, 0.05),
    (0.00, 0.00, 0.60, 0.20, 0.10, 0.10),
    (0.00, 0.00, 0.00, 0.50, 0.25, 0.25),
    (0.00, 0.05, 0.05, 0.05, 0.70, 0.15),
    (0.00, 0.00, 0.00, 0.00, 0.00, 1.00),
)

STATE_RISK = (0.05, 0.20, 0.60, 0.95, 0.15, 0.00)
HORIZONS = (1, 7, 14, 30, 90)
TIER_WEIGHT = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}
TIER_SCORE = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
COMPOSITE = {"exploit": 0.30, "impact": 0.25, "state": 0.25, "criticality": 0.20}
MATURITY = {"unproven": 0.1, "poc": 0.3, "proof-of-concept": 0.3, "functional": 0.6, "weaponized": 0.9, "high": 0.8}

FRESHNESS_DAYS = {"nvd": 7, "exploitdb": 14, "cisa_kev": 7, "otx": 14, "cmdb": 30, "vendor_advisories": 14, "network_scan": 7, "siem_alerts": 3}
FRESHNESS_WEIGHT = {"nvd": 3.0, "cisa_kev": 2.5, "exploitdb": 2.0, "otx": 1.5, "cmdb": 2.0, "vendor_advisories": 1.5, "network_scan": 2.0, "siem_alerts": 1.0}

CONFIDENCE_HALF_LIFE = 90.0
MITIGATED_HALF_LIFE, REMEDIATED_HALF_LIFE = 14.0, 3.0
RESIDUAL = {4: (0.30, MITIGATED_HALF_LIFE), 5: (0.05, REMEDIATED_HALF_LIFE)}
DAMPING, MAX_HOPS = 0.7, 4
COUPLING = 0.15
ENTRY_ZONES = ("dmz", "external", "internet-facing")

TOPSIS_WEIGHTS = {"risk_score": 0.30, "exploit_probability": 0.25, "asset_criticality": 0.20, "remediation_cost": 0.15, "time_exposure": 0.10}
TOPSIS_DEFAULT = {"composite_risk": 0.35, "exploit_likelihood": 0.25, "adjusted_impact": 0.25, "remediation_cost": 0.15}

# ---- Fixed values: node types, relations, allowed edges, file columns and file-name routes must equal those of existing graphs and feeds.

NODE_TYPES = ("Vulnerability", "Asset", "CWE", "CPE", "NetworkZone", "BusinessUnit", "Service", "ThreatActor", "Campaign", "TTP", "Indicator")
RELATIONS = ("AFFECTS", "HAS_CWE", "EXPLOITED_BY", "REFERENCES", "RUNS", "CONNECTS_TO", "IN_ZONE", "BELONGS_TO", "HOSTS_SERVICE", "PRESENT_ON", "TARGETS", "USES_TTP", "ATTRIBUTED_TO", "INDICATES")

#: Allowed (source type, relation, target type).
ONTOLOGY = (
    ("Vulnerability", "AFFECTS", "CPE"),
    ("Vulnerability", "HAS_CWE", "CWE"),
    ("Vulnerability", "EXPLOITED_BY", "ThreatActor"),
    ("Vulnerability", "REFERENCES", "Indicator"),
    ("Vulnerability", "PRESENT_ON", "Asset"),
    ("Asset", "RUNS", "CPE"),
    ("Asset", "CONNECTS_TO", "Asset"),
    ("Asset", "IN_ZONE", "NetworkZone"),
    ("Asset", "BELONGS_TO", "BusinessUnit"),
    ("Asset", "HOSTS_SERVICE", "Service"),
    ("ThreatActor", "TARGETS", "Vulnerability"),
    ("ThreatActor", "USES_TTP", "TTP"),
    ("Campaign", "ATTRIBUTED_TO", "ThreatActor"),
    ("Indicator", "INDICATES", "Campaign"),
)

#: Columns of the KEV file, and the spellings that stand for them.
KEV_FIELDS = {
    "cveID": ("cveID", "cve_id"),
    "vendorProject": ("vendorProject", "vendor_project"),
    "product": ("product",),
    "dateAdded": ("dateAdded", "date_added"),
    "dueDate": ("dueDate", "due_date"),
    "requiredAction": ("requiredAction", "required_action"),
    "knownRansomwareCampaignUse": ("knownRansomwareCampaignUse", "known_ransomware_campaign_use"),
}

#: File-name substrings and the source they mean; the first that fits counts.
ROUTES = (
    ("nvd", "nvd"),
    ("cve-", "nvd"),
    ("exploitdb", "exploitdb"),
    ("exploit_db", "exploitdb"),
    ("otx", "otx"),
    ("stix", "otx"),
    ("cmdb", "cmdb"),
    ("asset_inventory", "cmdb"),
    ("kev", "cisa_kev"),
    ("cisa", "cisa_kev"),
    ("vendor_advisory", "vendor_advisories"),
    ("advisory", "vendor_advisories"),
    ("network_scan", "network_scan"),
    ("scan_result", "network_scan"),
    ("siem", "siem_alerts"),
    ("alert", "siem_alerts"),
)
